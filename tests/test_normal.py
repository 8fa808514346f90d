import pathlib
import re

import pytest
from pyspark.sql import functions as F

from wayfold.functions import normal


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first()[0]


@pytest.mark.parametrize(("text", "want"), [(" A-1\t", "a-1"), (" x　", "x"), ("", None), ("  ", None), ("None", None), ("UNKNOWN ", None), ("n/a", None), ("-", None), (None, None), ("nonesuch", "nonesuch")])
def test_key(spark, text, want):
    assert one(spark, text, normal.key) == want


@pytest.mark.parametrize(("text", "want"), [("0x1", 1), ("0000000000000001", 1), (" FFFFFFFFFFFFFFFE", -2), ("ffffffffffffffff", None), ("0", None), ("0x0000000000000000", None), ("xyz", None), (None, None), ("12345678901234567", None), ("8000000000000000", -(2**63))])
def test_bits64(spark, text, want):
    assert one(spark, text, normal.bits64) == want


@pytest.mark.parametrize(("text", "want"), [("./a//B.JPG ", "a/b.jpg"), (".\\a\\b.jpg", "a/b.jpg"), ("a/./b", "a/b"), ("", None), (None, None)])
def test_path(spark, text, want):
    assert one(spark, text, normal.path) == want


@pytest.mark.parametrize(("value", "want"), [(1785196952, 1785196952000), (1785196952667, 1785196952667), (1785196952667123, 1785196952667), (1785196952667123456, 1785196952667), (0, None), (-5, None), (None, None)])
def test_epoch(spark, value, want):
    assert one(spark, value, normal.epoch_ms, "long") == want


def test_digest_and_names(spark):
    assert one(spark, "SHA256:ab ", normal.digest) == "ab"
    assert one(spark, "VAL ", normal.split_name) == "validation"
    assert one(spark, "Grey", normal.color) == "gray"
    assert [one(spark, x, normal.flag) for x in ("Yes", "0", "maybe", None)] == [True, False, None, None]


def test_nothing_else_needs_llm():
    root = pathlib.Path(normal.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"(from|import)\s+\S*\bllm\b", p.read_text()), p


def test_columns_do_not_clash(spark):
    df = spark.createDataFrame([("a ", "b")], "x string, key string")
    assert df.select(F.col("key"), normal.key("x").alias("k")).first() == ("b", "a")
