import random

from wayfold.operators import orphans

from .conftest import rows

REF = "evidence_frame_id string, event_id string, created_at_ms long, key string, n long"
DAY = 86_400_000


def test_against_brute_force_with_heavy_keys(spark):
    rng = random.Random(3)
    refs = [("hot" if i % 3 == 0 else "lost" if i % 3 == 1 else f"F{rng.randrange(400)} ", f"e{i}", rng.randrange(3 * DAY) + 10 * DAY, "x", 1) for i in range(3000)]
    refs += [(x, f"m{i}", 1, "x", 1) for i, x in enumerate([None, "", "none", " - "])]
    held = [("HOT ", 5)] * 3 + [(f"f{i}", 11 * DAY) for i in range(0, 400, 2)] + [(None, 1)]
    r = orphans.references(spark.createDataFrame(refs, REF), "t", "evidence_frame_id", "frames")
    h = orphans.targets(spark.createDataFrame(held, "frame_id string, save_time_ms long"), "frames", "frame_id", "save_time_ms")
    known = {"hot"} | {f"f{i}" for i in range(0, 400, 2)}
    keys = [(x.strip().lower(), e, c) for x, e, c, *_ in refs if x and x.strip().lower() not in ("", "none", "-")]
    want = sorted({("t", e) for x, e, _ in keys if x not in known})
    for share in (2, 50, 1000):
        assert rows(orphans.orphan_events(r, h, heavy_share=share)) == want
    report = {x["period_ms"]: (x["n_references"], x["n_orphans"]) for x in orphans.orphan_report(r, h).collect()}
    for day in {c - c % DAY for _, _, c in keys}:
        mine = [x for x, _, c in keys if c - c % DAY == day]
        assert report[day] == (len(mine), sum(x not in known for x in mine))


def test_empty_sides(spark):
    none = spark.createDataFrame([], REF)
    some = spark.createDataFrame([("f1", "e1", None, "x", 1)], REF)
    held = orphans.targets(spark.createDataFrame([], "frame_id string, save_time_ms long"), "frames", "frame_id", "save_time_ms")
    assert orphans.orphan_events(orphans.references(none, "t", "evidence_frame_id", "frames"), held).count() == 0
    assert rows(orphans.orphan_events(orphans.references(some, "t", "evidence_frame_id", "frames"), held)) == [("t", "e1")]
    assert rows(orphans.orphan_report(orphans.references(some, "t", "evidence_frame_id", "frames"), held)) == [("t", None, 1, 1, 0)]
