import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from wayfold.sources import files

from .conftest import rows


def test_csv_is_all_strings_with_mark(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_bytes(b"\xef\xbb\xbfa,b,c\n1,,\"x, \"\"y\"\"\"\n 2 ,0x1,\n")
    assert rows(files.csv_manifest(spark, str(p))) == [(" 2 ", "0x1", ""), ("1", "", 'x, "y"')]
    with pytest.raises(ValueError):
        files.csv_manifest(spark, str(p), ["zz"])


def test_last_line_wins(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k":"1","v":1}\n\n{"k":"2","v":2}\n{"k":"1","v":3}\n')
    (tmp_path / "b.jsonl").write_text('{"k":"2","v":9}\n')
    assert rows(files.json_lines(spark, str(tmp_path), "k", "k string, v int")) == [("1", 3), ("2", 9)]


def test_box_lines(spark, tmp_path):
    (tmp_path / "i.txt").write_text("0 0.5 0.5 0.2 0.2\n1 0.5 0.5 0 0.1\nx 1 1 1 1\n0 0.1 0.1 0.1\n\n")
    assert [r["valid"] for r in files.box_lines(spark, str(tmp_path)).orderBy("line_number").collect()] == [True, False, False, False]


def test_coco(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.json").write_text(json.dumps({"images": [{"id": 1, "file_name": f"f{i}", "width": 2, "height": 2}], "categories": [{"id": 3, "name": "car"}], "annotations": [{"id": 9, "image_id": 1, "category_id": 3, "bbox": [1, 2, 3, 4]}]}, indent=1))
    assert rows(files.coco(spark, str(tmp_path))) == [("f0", "car", 1.0, 2.0, 3.0, 4.0), ("f1", "car", 1.0, 2.0, 3.0, 4.0)]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/a.csv", "1")
        z.writestr("../evil.csv", "2")
        z.writestr("b.txt", "3")
    with tarfile.open(tmp_path / "b.tar", "w") as t:
        info = tarfile.TarInfo("c.csv")
        info.size = 2
        t.addfile(info, io.BytesIO(b"45"))
    assert sorted((r["member"], bytes(r["content"])) for r in files.archive_members(spark, str(tmp_path)).collect()) == [("c.csv", b"45"), ("x/a.csv", b"1")]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "a")], "x int, y string")
    files.publish(d, str(tmp_path / "p"))
    with pytest.raises(FileExistsError):
        files.publish(d, str(tmp_path / "p"))
    files.write_once(d, str(tmp_path / "q"))
    with pytest.raises(Exception, match="exist"):
        files.write_once(d, str(tmp_path / "q"))
    assert files.report_json(d) == '{\n  "x": 1,\n  "y": "a"\n}\n'
    m = spark.createDataFrame([("n", 1.5, 'a"b'), ("n", 2.0, None)], "name string, value double, l string")
    assert rows(files.metric_lines(m, labels={"t": "l"})) == [('n 2.0',), ('n{t="a\\"b"} 1.5',)] or rows(files.metric_lines(m, labels={"t": "l"})) == [('n{t="a\\"b"} 1.5',), ('n 2.0',)]


def test_a_batch_over_several_tables_is_seen_whole_or_not_at_all(spark, tmp_path):
    at = str(tmp_path / "store")
    one = spark.createDataFrame([(1, "x")], "k int, v string")
    broken = one.select("k", F.raise_error(F.lit("no")).cast("string").alias("v"))
    assert files.commit_batch({"a": one, "b": one}, at, "first")
    with pytest.raises(Exception, match="no"):
        files.commit_batch({"a": one, "b": broken}, at, "second")
    count = lambda name: files.committed(spark, at, name, one.schema).count()
    assert (count("a"), count("b"), count("none")) == (1, 1, 0)
    assert files.commit_batch({"a": one, "b": one}, at, "second") and not files.commit_batch({"a": one}, at, "second")
    assert (count("a"), count("b")) == (2, 2)


def test_large_members_are_an_error_unless_left_out(spark):
    import io
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.csv", "x" * 100)
        z.writestr("b.csv", "x")
    archives = spark.createDataFrame([("z", bytearray(held.getvalue()))], "path string, content binary")
    with pytest.raises(Exception, match="a.csv has 100 bytes"):
        files.members_of(archives, largest=50).collect()
    assert [r["member"] for r in files.members_of(archives, largest=50, leave_out_larger=True).collect()] == ["b.csv"]
