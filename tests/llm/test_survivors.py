import random

from tests.conftest import rows
from wayfold.llm import survivors as S

from .conftest import manifest, sha

TRUST = [("gold", 5), ("Silver ", 3), ("bronze", 1)]


def trust(spark):
    return spark.createDataFrame([(*t, "x") for t in TRUST], "annotation_source string, trust_rank int, row string")


def known(v):
    v = (v or "").strip().lower()
    v = "gray" if v == "grey" else v
    return None if v in ("", "unknown", "none") else v


def cases(records):
    rank = {"gold": 5, "silver": 3, "bronze": 1}
    groups, out = {}, []
    for i, r in enumerate(records, 1):
        if r.get("stage177_pixel_sha256"):
            groups.setdefault(r["stage177_pixel_sha256"], []).append((i, r))
    for g in groups.values():
        for f in S.FIELDS:
            k = [(r.get("reviewed_at_ms"), rank.get((r.get("annotation_source") or "").strip().lower(), 0), i, known(r.get(f))) for i, r in g if known(r.get(f))]
            if len({x[3] for x in k}) < 2 or all(x[0] is None for x in k):
                continue
            top = max(x[0] for x in k if x[0] is not None)
            best = [x for x in k if x[0] == top]
            if len(best) == 1 and max(x[1] for x in k) <= best[0][1]:
                out.append((best[0][2], f))
    return sorted(out)


def sample(seed, n=500, crops=90, hot=0):
    rng = random.Random(seed)
    pick = rng.choice
    return [
        {
            "stage177_pixel_sha256": sha("hot") if hot and i % hot == 0 else sha(rng.randrange(crops)), "body_type": pick(["suv", "SUV ", "sedan", "light_truck", "heavy_truck", None, "unknown"]), "color": pick(["grey", "gray", "white", "", "None"]),
            "crop_quality": pick(["good", "poor"]), "viewpoint": pick(["front", "front_three_quarter", "rear_three_quarter", None]), "annotation_source": pick(["gold", "SILVER", "bronze", "other", None]), "reviewed_at_ms": pick([None, *range(40)]),
        }
        for i in range(n)
    ]


def test_found_against_brute_force(spark):
    for seed, hot in ((1, 0), (2, 3)):
        records = sample(seed, hot=hot)
        assert rows(S.clear_cases(manifest(spark, records), trust(spark))) == cases(records)


def test_each_crop_survives_once(spark):
    records = sample(3) + [{"stage177_pixel_sha256": None, "color": "Grey "}, {"stage177_pixel_sha256": "  "}]
    out = S.survivors(manifest(spark, records), trust(spark)).collect()
    crops = {r["stage177_pixel_sha256"] for r in records[:-2]}
    assert sorted(r["pixel_sha256"] for r in out if r["pixel_sha256"]) == sorted(crops)
    assert sorted((r["representative"], r["color"]) for r in out if not r["pixel_sha256"]) == [(501, "gray"), (502, None)]
    by = {r["pixel_sha256"]: r for r in out}
    for crop in crops:
        group = [r for r in records if r["stage177_pixel_sha256"] == crop]
        assert by[crop]["n_rows"] == len(group)
        for f in S.FIELDS:
            values = {known(r[f]) for r in group} - {None}
            assert by[crop][f] in values if values else by[crop][f] is None
    for row, f in cases(records):
        assert by[records[row - 1]["stage177_pixel_sha256"]][f] == known(records[row - 1][f])


def test_consensus_votes_by_token():
    # three views of equal weight: the tokens front and quarter win their columns
    assert S.consensus(("front_three_quarter", "rear_three_quarter", "front_quarter"), (1 / 3, 1 / 3, 1 / 3)) == 0
    assert S.consensus(("suv", "sedan", "van"), (1.0, 0.2, 0.04)) == 0
    assert S.consensus(("a b c", "a x c", "a x c"), (0.4, 0.3, 0.3)) == 1
    assert S.consensus(("--", "b"), (1.0, 0.1)) == 0


def test_empty_ties_and_repeats(spark):
    assert S.survivors(manifest(spark, []), trust(spark)).count() == 0
    assert S.clear_cases(manifest(spark, []), trust(spark)).count() == 0
    tie = [{"stage177_pixel_sha256": sha(1), "color": c, "reviewed_at_ms": 5, "annotation_source": "gold"} for c in ("red", "blue", "blue")]
    assert S.clear_cases(manifest(spark, tie), trust(spark)).count() == 0
    out = S.survivors(manifest(spark, tie), trust(spark)).first()
    assert (out["color"], out["n_rows"], out["n_disputed"]) == ("blue", 3, 1)
    no_trust = spark.createDataFrame([], "annotation_source string, trust_rank int")
    assert S.survivors(manifest(spark, tie), no_trust).first()["color"] == "blue"
    again = [{"stage177_row_number": 1, "stage177_pixel_sha256": sha(1), "color": "red", "reviewed_at_ms": 5}] * 2 + [{"stage177_pixel_sha256": sha(1), "color": "blue", "reviewed_at_ms": 4}]
    assert rows(S.clear_cases(manifest(spark, again), trust(spark))) == [(1, "color")]


def test_every_column_of_the_manifest_survives(spark):
    at = "/root/testdata/sf0.001"
    whole = spark.read.parquet(f"{at}/attribute_manifest.parquet")
    out = S.survivors(whole, spark.read.parquet(f"{at}/annotation_trust.parquet"))
    assert set(whole.columns) - set(out.columns) == {"stage177_row_number", "stage177_pixel_sha256"}  # these have names of their own
    paths = {r["stage177_row_number"]: (r["image_path"], r["reviewed_at_ms"]) for r in whole.collect()}
    assert all(paths[r["representative"]] == (r["image_path"], r["reviewed_at_ms"]) for r in out.collect())


def test_carried_columns_and_settled_flags(spark):
    names = "stage177_row_number long, stage177_pixel_sha256 string, body_type string, color string, color_supervised string, annotation_source string, reviewed_at_ms long, split string, image_path string, stage177_dhash64 string, stage177_mean_luma string, stage177_near_duplicate_of string, stage177_read_error string, stage177_label_conflict string"
    data = [
        (1, sha(1), "suv", "red", "no", "bronze", 9, "val", "a.jpg", "00FF", "7.25", "x.jpg", "", "True"),
        (2, sha(1), "suv", "blue", "yes", "gold", 1, "validation", "B.jpg", "", None, " ", None, "True"),
        (3, sha(2), "suv", "red", None, "gold", 1, "train", "c.jpg", None, "1", None, None, "False"),
        (4, sha(2), "suv", "blue", None, "gold", 2, "test", "d.jpg", None, "2", None, None, "False"),
        (5, sha(3), "suv", "red", None, "gold", 2, "test", "e.jpg", None, "2", None, "OSError", "False"),
    ]
    out = {r["representative"]: r for r in S.survivors(spark.createDataFrame(data, names), trust(spark)).collect()}
    assert set(out) == {2, 4, 5}
    carried = lambda r: tuple(r[c] for c in ("image_path", "annotation_source", "reviewed_at_ms", "split", "stage177_dhash64", "stage177_mean_luma", "stage177_near_duplicate_of", "stage177_read_error"))
    assert carried(out[2]) == ("B.jpg", "gold", 1, "validation", "00000000000000ff", 7.25, None, None)
    assert carried(out[4]) == ("d.jpg", "gold", 2, "test", None, 2.0, None, None)
    assert carried(out[5]) == ("e.jpg", "gold", 2, "test", None, 2.0, None, "OSError")
    # the one unsupervised color of crop 1 is no conflict; a read error leaves no eligible row
    assert {k: tuple(r[f] for f in S.SETTLED) for k, r in out.items()} == {2: (False, True, True), 4: (True, False, False), 5: (False, False, False)}


def crop_of(values, name="a"):
    """Rows of one crop from (color, source, day of review)."""
    return [{"stage177_pixel_sha256": sha(name), "color": c, "annotation_source": s, "reviewed_at_ms": None if d is None else d * 86_400_000} for c, s, d in values]


def test_the_vote_can_overrule_the_top_row(spark):
    # gold has the highest trust, but is old; the latest row is ranked below it and has support
    data = crop_of([("red", "gold", 1000), ("blue", "silver", 1400), ("blue", "silver", 1390), ("blue", "bronze", 1300)])
    out = S.survivors(manifest(spark, data), trust(spark)).first()
    assert (out["color"], out["representative"], out["n_disputed"]) == ("blue", 1, 1)
    assert S.clear_cases(manifest(spark, data), trust(spark)).count() == 0  # gold outranks the latest row
    # the latest row is of low rank and alone: the trusted rows, not much older, add up
    data = crop_of([("red", "gold", 1398), ("red", "silver", 1399), ("blue", "bronze", 1400)])
    assert S.survivors(manifest(spark, data), trust(spark)).first()["color"] == "red"


def test_one_clear_row_outweighs_any_number_of_others(spark):
    data = crop_of([("blue", "gold", 1400), *[("red", s, d) for s in ("gold", "silver", "bronze", None) for d in (*range(1380, 1400), None)] * 5])
    assert S.survivors(manifest(spark, data), trust(spark)).first()["color"] == "blue"
    assert rows(S.clear_cases(manifest(spark, data), trust(spark))) == [(1, "color")]


def test_votes_over_many_values_are_held_in_blocks(spark):
    data = crop_of([(f"shade {i} of red", "gold", 1000 + i) for i in range(60)]) + crop_of([("x", "gold", 3), ("y", "bronze", 9)], "b")
    whole, blocks = (S.survivors(manifest(spark, data), trust(spark), voters=v).collect() for v in (500, 7))
    color = lambda out: {r["pixel_sha256"]: r["color"] for r in out}
    assert color(whole) == color(blocks) and color(whole)[sha("a")] == "shade 59 of red"
    assert rows(S.clear_cases(manifest(spark, data), trust(spark))) == [(60, "color")]


def test_identifiers_come_from_the_best_row_that_has_one(spark):
    data = [r | {"camera_id": c, "track_group": f"T{i}"} for i, (r, c) in enumerate(zip(crop_of([("red", "gold", 5), ("red", "silver", 9), ("red", "silver", 7)]), (" ", "CAM-2", "cam-3"), strict=True))]
    out = S.survivors(manifest(spark, data), trust(spark)).first()
    assert (out["camera_id"], out["track_group"], out["color"], out["n_disputed"]) == ("cam-2", "t0", "red", 0)
