import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from wayfold.llm import overlap
from wayfold.session import Scratch

from .conftest import manifest, sha


def brute(records, radius=4):
    side = lambda s: {"train": 1, "val": 0, "validation": 0, "test": 0}.get((s or "").strip().lower())
    out = set()
    for i, a in enumerate(records, 1):
        for j, b in enumerate(records, 1):
            if side(a["split"]) == 1 and side(b["split"]) == 0:
                ha, hb = a.get("stage177_dhash64"), b.get("stage177_dhash64")
                near = ha and hb and bin(int(ha, 16) ^ int(hb, 16)).count("1") <= radius and all(int(h, 16) not in (0, 2**64 - 1) for h in (ha, hb))
                pa, pb = ((x.get("stage177_pixel_sha256") or "").strip().lower().removeprefix("sha256:") for x in (a, b))
                if near or (pa and pa == pb):
                    out.add((min(i, j), max(i, j)))
    return sorted(out)


def sample(seed, n=400, hot=False):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(40)]
    out = []
    for i in range(n):
        h = rng.choice(base)
        for _ in range(rng.choice([0, 1, 3, 4, 5, 6])):
            h ^= 1 << rng.randrange(64)
        if hot and i % 3 == 0:
            h = (h & ~(0x1FFF << 51)) | (0x155 << 51)  # a third of all hashes share their first block
        out.append({"split": rng.choice(["train", " Train", "val", "TEST ", "validation", None, ""]), "stage177_dhash64": rng.choice([f"{h:016x}", f"0x{h:X}", f"{h:x}"]), "stage177_pixel_sha256": rng.choice([sha(i % 60), "SHA256:" + sha(i % 60).upper(), None, ""]), "source_dataset": rng.choice(["a", "B ", None])})
    return out


@pytest.mark.parametrize(("seed", "hot", "how"), [(1, False, {}), (2, True, {}), (3, True, {"refine_over": 2}), (4, True, {"refine_over": 2, "salt_over": 3}), (5, False, {"salt_over": 1})])
def test_against_brute_force(spark, seed, hot, how):
    records = sample(seed, hot=hot)
    assert rows(overlap.row_pairs(manifest(spark, records), **how)) == brute(records)


@pytest.mark.parametrize("radius", [0, 2])
def test_smaller_radius(spark, radius):
    records = [r | {"stage177_pixel_sha256": None} for r in sample(9)]
    assert rows(overlap.row_pairs(manifest(spark, records), radius=radius)) == brute(records, radius)


def test_report_counts_pairs(spark):
    records = sample(6)
    r = overlap.overlap_report(manifest(spark, records)).collect()
    same = [x | {"stage177_dhash64": None} for x in records]
    near = [x | {"stage177_pixel_sha256": None} for x in records]
    assert sum(x["n_same_pairs"] for x in r) == len(brute(same)) and sum(x["n_near_pairs"] for x in r) == len(brute(near))
    evals = {j for p in brute(records) for j in p if (records[j - 1]["split"] or "").strip().lower() != "train"}
    assert sum(x["n_overlap_rows"] for x in r) == len(evals)
    assert {x["source_dataset"] for x in r} <= {"a", "b", "unknown"}


def test_flat_hashes_nulls_and_long_text(spark):
    x = "ab" * 200_000
    records = [{"split": "train", "stage177_dhash64": h, "stage177_pixel_sha256": p} for h, p in [("0", None), ("f" * 16, "none"), (None, x), ("zz", x.upper())]]
    records += [{"split": "test", "stage177_dhash64": h, "stage177_pixel_sha256": p} for h, p in [("1", None), ("f" * 16, "NONE"), (None, x), (None, None)]]
    assert rows(overlap.row_pairs(manifest(spark, records))) == [(3, 7), (4, 7)]


def test_repeated_rows_and_empty_tables(spark):
    records = [{"stage177_row_number": 1, "split": "train", "stage177_pixel_sha256": sha(1)}] * 2 + [{"stage177_row_number": 2, "split": "test", "stage177_pixel_sha256": sha(1)}] * 2
    assert rows(overlap.row_pairs(manifest(spark, records))) == [(1, 2)]
    assert overlap.row_pairs(manifest(spark, [])).count() == 0
    assert overlap.overlap_report(manifest(spark, [])).count() == 0
    only = [{"split": "train", "stage177_pixel_sha256": sha(1)}]
    assert overlap.row_pairs(manifest(spark, only)).count() == 0


def test_a_hash_of_a_third_of_all_rows_is_counted_not_paired(spark):
    records = [{"split": "train" if i % 2 else "test", "stage177_pixel_sha256": sha("hot" if i % 3 else i), "source_dataset": "a"} for i in range(3000)]
    r = overlap.overlap_report(manifest(spark, records)).collect()
    t = sum(1 for i in range(3000) if i % 3 and i % 2)
    e = sum(1 for i in range(3000) if i % 3 and not i % 2)
    assert [(x["n_same_rows"], x["n_same_pairs"]) for x in r] == [(e, t * e)]


def test_maximal_matches_are_merged(spark):
    """Span and number of the maximal matches of each pair of codes, against the bits themselves."""
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(30)]
    flip = lambda h: h ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5)))
    codes = {(side, flip(h)) for h in base for side in (0, 1) for _ in range(6)}
    df = spark.createDataFrame([(s, bytearray(h.to_bytes(8, "big"))) for s, h in codes], "side int, code binary")
    want = {}
    for s, t in codes:
        for z, e in codes:
            if s == 1 and z == 0 and (t ^ e).bit_count() <= 4:
                equal = [(t ^ e) >> at & ((1 << w) - 1) == 0 for at, w in overlap.BLOCKS]
                runs = 1 if all(equal) else sum(equal[k] and not equal[(k + 1) % 5] for k in range(5))
                want[t, e] = ((t ^ e).bit_count(), sum(w for (_, w), q in zip(overlap.BLOCKS, equal, strict=True) if q), runs)
    for how in ({}, {"refine_over": 1}, {"refine_over": 0, "salt_over": 2}, {"salt_over": 1}):
        m = overlap.code_matches(df, Scratch(spark, "test"), **how).collect()
        got = {(int.from_bytes(r["train_code"], "big"), int.from_bytes(r["eval_code"], "big")): (r["distance"], r["span"], r["n_spans"]) for r in m}
        assert len(m) == len(got) and got == want, how


def test_nearly_constant_hashes_are_spread_over_tasks(spark):
    """100,000 codes that differ in their lowest 17 bits only: no cell holds more than its share, and none is lost."""
    n = 100_000
    codes = spark.range(n).select((F.col("id") % 2).cast("int").alias("side"), F.unhex(F.lpad(F.hex(F.lit(0x5555 << 40) + F.col("id")), 16, "0")).alias("code"))
    sent, parts = overlap.routes(codes, Scratch(spark, "test"), salt_over=2000)
    cells = sent.groupBy("seed", "value", "salt").agg(F.count_if(F.col("side") == 0).alias("e"), F.count_if(F.col("side") == 1).alias("t"))
    most = cells.agg(F.max("e"), F.max("t"), F.count("*")).first()
    assert most[0] <= 2600 and most[1] <= 2600 and most[2] > 1000
    # every pair of codes that shares a key meets in one cell of it
    grid = sent.groupBy("seed", "value").agg(F.countDistinct(F.when(F.col("side") == 0, F.col("code"))).alias("e"), F.countDistinct(F.when(F.col("side") == 1, F.col("code"))).alias("t"))
    met = cells.groupBy("seed", "value").agg(F.sum(F.col("e") * F.col("t")).alias("met"))
    assert grid.join(met, ["seed", "value"]).where("met <> e * t").count() == 0
