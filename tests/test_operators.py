import itertools
import random

import pytest
from pyspark.sql import functions as F

from wayfold.functions import predicates as P
from wayfold.functions import scalar as X
from wayfold.operators import calibration, consensus, relational, sampling, similarity
from wayfold.plans.catalog import core

from .conftest import rows


def flip(x, *bits):
    for b in bits:
        x ^= 1 << b
    return x - 2**64 if x >= 2**63 else x


def test_hamming_boundaries(spark):
    base = 0x1234567890ABCDEF
    a = spark.createDataFrame([(base,), (0,), (None,)], "bits long")
    b = spark.createDataFrame([(flip(base, 1, 17, 35, 58),), (flip(0, 1, 14, 27, 40, 53),)], "bits long")
    assert rows(similarity.hamming_pairs(a, b, 4)) == [(base, flip(base, 1, 17, 35, 58), 4)]
    apart = spark.createDataFrame([(flip(base, 1, 17, 35, 60),)], "bits long")
    assert similarity.hamming_pairs(a, apart, 4, exact=False).count() == 0  # one bit in every band
    assert similarity.hamming_pairs(a, apart, 4).count() == 1


def test_refined_blocks_give_the_same_pairs(spark):
    """Hashes that share their first block, or all but a few bits; every way of routing them against brute force."""
    rng = random.Random(3)
    base = [rng.getrandbits(51) for _ in range(20)]
    bits = {flip((0x155 << 51) | rng.choice(base), *rng.sample(range(64), rng.randrange(6))) for _ in range(300)}
    df = spark.createDataFrame([(b, "a" if b % 3 else "b") for b in bits], "bits long, color string")
    near = lambda r: sorted((a, b, bin((a ^ b) & (2**64 - 1)).count("1")) for a in bits for b in bits if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= r)
    for radius, over in ((4, 4096), (4, 5), (4, 0), (2, 2)):
        assert rows(similarity.hamming_pairs(df, df, radius, refine_over=over).where("left_bits < right_bits")) == near(radius)
    got = rows(similarity.hamming_pairs(df, df, 3, within="color", refine_over=5).where("left_bits < right_bits").select("left_bits", "right_bits"))
    assert got == [(a, b) for a, b, _ in near(3) if bool(a % 3) == bool(b % 3)]


def test_a_long_chain_ends(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(900)], "a long, b long")
    ids = spark.range(901)
    for last in (100_000, 880):
        assert [r["id"] for r in similarity.leaders(ids, chain, last_pairs=last).where("kept").orderBy("id").collect()] == list(range(0, 901, 2))


def test_leaders_and_components_against_brute_force(spark):
    rng = random.Random(7)
    for _ in range(3):
        ids = list(range(60))
        pairs = sorted({tuple(sorted(rng.sample(ids, 2))) for _ in range(45)})
        kept = set()
        for i in ids:
            if not any((a, b) in set(pairs) and (a if b == i else b) in kept for a, b in pairs if i in (a, b) and min(a, b) < i):
                kept.add(i)
        df = spark.createDataFrame(pairs, "a long, b long")
        got = {r["id"] for r in similarity.leaders(spark.createDataFrame([(i,) for i in ids], "id long"), df).collect() if r["kept"]}
        assert got == kept
        root = {i: i for i in ids}
        for _ in ids:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        want = sorted((i, root[i]) for i in {x for p in pairs for x in p})
        assert rows(similarity.components(df)) == [(a, b) for a, b in want] or sorted(rows(similarity.components(df))) == want


def test_votes(spark):
    o = spark.createDataFrame([(1, "a", 2, 10), (1, "b", 2, 10), (1, "unknown", 9, 10), (2, "unknown", 1, 1), (3, "z", 5, 0)], "t int, label string, w long, b long")
    v = {r["t"]: (r["label"], r["confidence"], r["samples"], r["stable"]) for r in consensus.weighted_vote(o, ["t"], "label", F.col("w"), F.col("b"), 1, 0.05).collect()}
    assert v == {1: ("a", 2 / 30, 1, True), 2: ("unknown", 0.0, 0, False), 3: ("unknown", 0.0, 1, False)}
    s = {r["t"]: (r["label"], r["share"]) for r in consensus.share_margin_vote(o, ["t"], "label", F.col("w"), 0.5, 0.0).collect()}
    assert s == {1: ("a", 0.5), 2: ("unknown", 0.0), 3: ("z", 1.0)}
    assert rows(consensus.view_consensus(o, ["t"], "label", "w", 1, 0)) == [(1, "unknown", 9), (2, "unknown", 1), (3, "z", 5)]


def test_joint_thresholds():
    best = calibration.joint_thresholds([("white", 8, 8, 0.60), ("black", 4, 0, 0.90)], 0.93)
    assert best["selected"] == 8 and best["thresholds"] == {"black": 1.01, "white": 0.60}
    assert calibration.joint_thresholds([("green", 10, 10, 0.5), ("red", 2, 1, 0.5)], 0.90)["selected"] == 12
    with pytest.raises(ValueError):
        calibration.joint_thresholds([("a", 5, 0, 0.5)], 0.9)


def test_joint_thresholds_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        options = []
        for label in "abc":
            n = c = 0
            for step in range(6, 0, -1):
                more = rng.randint(1, 6)
                n, c = n + more, c + rng.randint(0, more)
                options.append((label, n, c, step / 8))
        precision = rng.choice([0.5, 0.7, 0.9, 5 / 7, 1.0])
        sums = [tuple(map(sum, zip(*o, strict=True))) for o in itertools.product(*[[(0, 0, 1.01), *[o[1:] for o in options if o[0] == label]] for label in "abc"])]
        want = max(((n, c / n, round(t, 6)) for n, c, t in sums if n and c / n >= precision), default=None)
        try:
            best = calibration.joint_thresholds(options, precision)
            assert (best["selected"], best["precision"], round(sum(best["thresholds"].values()), 6)) == want
        except ValueError:
            assert want is None


def test_joint_thresholds_takes_every_threshold(spark, tmp_path):
    # at 45 nine of ten are right, at 40 five of twelve: only a grid of ones finds 45
    told = [(50, True)] * 5 + [(45, True)] * 4 + [(45, False)] + [(40, False)] * 12
    ids = {True: 0, False: 14}  # (id * 7) % 100 < k says whether the event is right
    spark.createDataFrame([(1, ids[ok], "view", f'{{"k": {k}}}') for k, ok in told], "user_id long, event_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = core.queries["c4_joint_thresholds"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("view", 0.45, 10, 0.9)]


def test_gate_and_pareto(spark):
    d = spark.createDataFrame([("white", 0.60, 0.50), ("black", 0.90, 0.95), ("white", 0.80, 0.50), ("red", 0.99, None), ("unknown", 1.0, 0.1)], "label string, c double, t double")
    assert [r[0] for r in d.select(P.gated("label", "c", "t")).collect()] == ["white", "unknown", "white", "unknown", "unknown"]
    pts = spark.createDataFrame([(1, 0.95, 0.20), (2, 0.931, 0.50), (3, 0.92, 0.80), (4, 0.92, 0.70), (5, 0.95, 0.20)], "k int, p double, v double")
    assert sorted(r["k"] for r in calibration.pareto(pts, "k", "p", "v").collect()) == [1, 2, 3, 5]


def test_pages_ranges_and_expiry(spark):
    d = spark.createDataFrame([(i, i % 3) for i in range(10)], "id int, v int")
    assert [r["id"] for r in relational.page(d, [F.desc("v"), F.col("id")], 0, -5).collect()] == [2]
    assert [r["id"] for r in d.where(P.optional_range("id", 3, 3)).collect()] == [3]
    with pytest.raises(ValueError):
        P.optional_range("id", 5, 4)
    expired, kept = relational.split_expired(d, ["id"], "id", F.lit(4), 3, [F.col("id")])
    assert rows(expired.select("id")) == [(0,), (1,), (2,)] and kept.count() == 7


def test_storage_pressure(spark):
    f = spark.createDataFrame([(f"f{i}", "t", i, i, 80) for i in range(3)], "frame_id string, task_id string, capture_time_ms long, save_time_ms long, size_bytes long")
    assert rows(relational.pressure_sweep(f, F.lit(100)).select("frame_id")) == [("f0",), ("f1",)]


def test_scalars(spark):
    d = spark.createDataFrame([("rtsp://u:p@host/a?x=1#y", 3)], "u string, a int")
    r = d.select(X.masked_uri("u").alias("u"), X.masked_uri(F.lit("http://x")).alias("h"), X.backoff("a", 1000, 3000).alias("d"), X.wilson_lower(F.lit(0), F.lit(0)).alias("w"), X.hmac_sha256("k")(F.lit("1"), F.lit("b")).alias("s")).first()
    assert (r["u"], r["h"], r["d"], r["w"], len(r["s"])) == ("rtsp://***:***@host/a", "***", 3000, 0.0, 64)


def test_seeded_split_and_samples(spark):
    s = sampling.seeded_split([f"g{i}" for i in range(20)])
    assert sorted(s.values()).count("train") == 14 and s == sampling.seeded_split([f"g{i}" for i in reversed(range(20))])
    d = spark.createDataFrame([(i, "a") for i in range(9)], "i int, k string")
    assert [r["i"] for r in sampling.evenly_spaced(d, ["k"], [F.col("i")], 3).orderBy("i").collect()] == [0, 4, 8]
    q = spark.createDataFrame([("x", i) for i in range(50)] + [("y", i) for i in range(100, 103)], "label string, key int")
    assert sampling.quotas(q, "label", "key", 20).count() == 20


def test_partitions_do_not_matter(spark):
    d = spark.createDataFrame([(i % 5, f"l{i % 3}", i % 7, 3) for i in range(200)], "t int, label string, w long, b long")
    f = lambda x: rows(consensus.weighted_vote(x, ["t"], "label", F.col("w"), F.col("b"), 1, 0.05))
    assert f(d.repartition(1)) == f(d.repartition(7).orderBy(F.rand(1)))


def test_sticky_shards(spark):
    """Closed form against assignment one by one."""
    rng = random.Random(6)
    for n in (0, 1, 5, 30):
        held = [(i, rng.choice([0, 0, 1, 3])) for i in range(n)]
        load, want = [sum(s == k for _, s in held) for k in range(4)], dict(held)
        for i in range(n, n + 12):
            want[i] = min(range(4), key=lambda k: (load[k], k))
            load[want[i]] += 1
        keys = spark.createDataFrame([(i, i) for i in range(n + 12)], "task long, o long")
        got = relational.sticky_shards(keys, spark.createDataFrame(held, "task long, shard int"), 4, "task", "o")
        assert {r["task"]: r["shard"] for r in got.collect()} == want


def test_reviews_override_or_fail(spark):
    m = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], "k int, color string, other string")
    r = spark.createDataFrame([(2, "red"), (1, None)], "k int, color string")
    assert rows(relational.overridden(m, r, "k")) == [(1, "a", "x"), (2, "red", "y")]
    with pytest.raises(ValueError, match="7"):
        relational.overridden(m, spark.createDataFrame([(7, "red")], "k int, color string"), "k")


def test_choice_of_a_sweep(spark):
    pts = spark.createDataFrame([(1, 0.9, 5), (2, 0.8, 9), (3, 0.95, 5), (4, None, 50)], "t int, p double, n int")
    pick = lambda least: [r["t"] for r in calibration.chosen(pts, F.col("p") >= least, [F.col("n"), F.col("p")], [F.col("p")], [F.col("t")]).where("chosen").collect()]
    assert pick(0.9) == [3] and pick(0.5) == [2] and pick(0.99) == [3]


def test_recovery_is_refused_beyond_the_limit(spark):
    from wayfold.plans.relational import recovery_plan

    t = spark.createDataFrame([("a", True, None, "running"), ("b", True, None, "running"), ("c", False, None, "running")], "task_id string, enabled boolean, deleted_at_ms long, desired_state string")
    c = spark.createDataFrame([("a", 1, "r1", "m", "camera_frame_start")], "task_id string, create_time_ms long, run_id string, message_id string, command_kind string")
    assert [r["reason"] for r in recovery_plan(t, c, 1).collect()] == ["capacity_exceeded"]
    assert sorted((r["task_id"], r["action"]) for r in recovery_plan(t, c, 2).collect()) == [("a", "fail_run"), ("a", "start_run"), ("b", "start_run")]


def test_difference_hash_conventions(spark):
    v = spark.createDataFrame([([1, 2, 2, 1] + [5, 4, 3, 9],)], "v array<int>")
    assert v.select(X.dhash_bits(F.col("v"), True, 2, 3), X.dhash_bits(F.col("v"), False, 2, 3)).first()[:] == ("100001", "001110")


def test_sums_before_are_those_of_a_window(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, *range(0, 50_000_000, 700_001)]), i, rng.randrange(9)) for i in range(300)]
    d = spark.createDataFrame(data, "g string, t long, id long, v int")
    for descending in (False, True):
        order = [F.desc("t") if descending else F.asc("t"), F.col("id")]
        got = {r["id"]: (r["_before"], r["_total"]) for r in relational.sums_before(d, ["g"], "t", order, F.col("v"), descending).collect()}
        ranked = sorted(data, key=lambda r: ((r[1] is None, -(r[1] or 0)) if descending else (r[1] is not None, r[1] or 0), r[2]))
        want, total = {}, {}
        for g, _, i, v in ranked:
            want[i] = total.get(g, 0)
            total[g] = want[i] + v
        assert got == {i: (want[i], total[g]) for g, _, i, _ in data}


def test_inserts_name_the_constraint_they_break(spark):
    old = spark.createDataFrame([("a", 1), (None, 2)], "k string, other int")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "k string, v int")
    assert rows(relational.inserted(old, new, "k", [F.col("v")]).select("v", "outcome")) == [(1, "unique_violation"), (2, "inserted"), (3, "unique_violation"), (4, "not_null_violation")]


def test_plans_by_quota_and_rarity():
    from wayfold.plans.stateful import bounded_plan, rarest_first

    offers = [((i,), s, 1, 0) for i, s in enumerate("aaab")] + [((i,), s, 1, 1) for i, s in enumerate("aaab")]
    assert list(bounded_plan(offers, 1, 3, 10)) == [(0,), (3,), (1,)]
    assert list(bounded_plan(offers, 1, 9, 2)) == [(0,), (3,)]
    groups = [(f"g{i}", {"rare": 1} if i < 4 else {"common": 5}) for i in range(20)]
    out = dict(rarest_first(iter(groups), {"rare": 4, "common": 80}, 20))
    assert [list(out.values()).count(s) for s in ("train", "validation", "test")] == [14, 3, 3]
    assert {out[f"g{i}"] for i in range(4)} == {"train", "validation", "test"}


def test_ranked_caps_do_not_depend_on_how_far_they_look(spark):
    from wayfold.plans.stateful import t13

    d = "/root/testdata/sf0.01"
    assert rows(t13(spark, d, 201)) == rows(t13(spark, d, 10**9))


def test_hmac_is_that_of_the_library(spark):
    import hashlib
    import hmac

    d = spark.createDataFrame([("1", "body"), ("2", ""), (None, "x"), ("3", "größer 路口")], "t string, b string")
    for secret in ("k", "s" * 64, "long " * 30):
        want = [None if t is None else hmac.new(secret.encode(), f"{t}\n{b}".encode(), hashlib.sha256).hexdigest() for t, b in (("1", "body"), ("2", ""), (None, "x"), ("3", "größer 路口"))]
        assert [r[0] for r in d.select(X.hmac_sha256(secret)(F.col("t"), F.col("b"))).collect()] == want
