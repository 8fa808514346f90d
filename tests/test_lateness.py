import random
from collections import Counter

from pyspark.sql import functions as F

from wayfold.operators import lateness

from .conftest import rows

V = "event_id string, event_kind string, occurred_at_ms long, created_at_ms long, hour string"
T = "event_id string, last_seen_at_ms long, created_at_ms long, kind int"
H = 3_600_000
BASE = 496_000 * H


def frames(spark, v, t=()):
    limits = spark.createDataFrame([("vehicle_passage", 900_000), ("Algorithm_Alert ", 300_000)], "event_kind string, allowed_lateness_ms long")
    return spark.createDataFrame([(*r, "x") for r in v], V), spark.createDataFrame([(*r, 1) for r in t], T), limits


def test_boundaries_units_and_copies(spark):
    v = [
        ("a", "vehicle_passage", BASE + 5, BASE + H + 900_000),  # at the limit: in time
        ("b", "VEHICLE_PASSAGE ", BASE + 5, BASE + H + 900_001),  # beyond it
        ("c", "algorithm_alert", (BASE + 5000) // 1000, BASE + H + 300_001),  # seconds
        ("d", "algorithm_alert", (BASE + 5) * 1000, BASE + H + 300_001),  # microseconds
        ("e", "algorithm_alert", None, BASE + 99 * H),
        ("f", "algorithm_alert", 0, BASE + 99 * H),
        (" G", "algorithm_alert", BASE, BASE + 99 * H),
        ("g", "algorithm_alert", BASE, BASE + 1),  # the first copy came in time
        ("h", "other", BASE, BASE + 99 * H),
        (None, "algorithm_alert", BASE, BASE + 99 * H),
    ]
    t = [("a", BASE + 1, BASE + H + 900_001)]
    assert rows(lateness.late_events(*frames(spark, v, t))) == [("vehicle_track_results", "a"), ("vision_events", "b"), ("vision_events", "c"), ("vision_events", "d")]


def test_deltas_fold_to_the_final_state(spark):
    rng = random.Random(5)
    v = [(f"e{i}", "vehicle_passage", t := BASE + rng.randrange(3 * H), t + rng.choice([1, 1000, H, H + 400_000, 5 * H])) for i in range(800)]
    vision, tracks, limits = frames(spark, v)
    events = lateness.admitted(lateness.arrivals(vision, tracks), limits)
    changes = lateness.deltas(events)
    want = Counter(o - o % H for _, _, o, c in v if c <= o - o % H + H + 900_000)
    assert {r["period_ms"]: r["n_events"] for r in lateness.folded(changes).collect()} == want
    by_version = {}
    for r in changes.collect():
        by_version.setdefault((r["hour_ms"], r["version"]), {})[r["sign"]] = r["n_events"]
    for (hour, version), signs in by_version.items():
        if version:  # what is retracted is what the version before had asserted
            assert signs[-1] == by_version[hour, version - 1][1] and signs[1] > signs[-1]
        else:
            assert set(signs) == {1}
    assert sum(r["n_events"] for r in lateness.folded(changes, 24 * H).collect()) == sum(want.values())


def test_empty(spark):
    assert lateness.late_events(*frames(spark, [])).count() == 0
    assert lateness.hourly(*frames(spark, [])).count() == 0


def in_batches(spark, tmp_path, v, cuts, **how):
    """Applies events in the order of arrival, cut into batches; the state, and all deltas that were sent."""
    vision, tracks, limits = frames(spark, v)
    rows_ = lateness.copies(vision, tracks).persist()
    state = lateness.HourlyState(limits, str(tmp_path / "state"), **how)
    sent = []
    for i, (low, high) in enumerate(zip([-1, *cuts], [*cuts, 10**15], strict=True)):
        sent += state.apply(rows_.where((F.col("created") > low) & (F.col("created") <= high)), f"b{i}").collect()
    return state, sent


def test_batches_one_by_one_equal_one_run(spark, tmp_path):
    rng = random.Random(8)
    v = []
    for i in range(400):
        t = BASE + rng.randrange(3 * H)
        for _ in range(rng.choice([1, 1, 1, 2])):  # copies, some of which lack the time
            v.append((f"e{i}", "vehicle_passage", rng.choice([t, t, t, None]), t + rng.choice([1, 1000, H, H + 400_000, 5 * H])))
    v += [(None, "vehicle_passage", BASE + 5, BASE + 9), (None, "vehicle_passage", BASE + 5, BASE + 9)]
    created = sorted(c for *_, c in v)
    state, sent = in_batches(spark, tmp_path, v, [created[100], created[250], created[400]])
    vision, tracks, limits = frames(spark, v)
    whole = lateness.folded(lateness.deltas(lateness.admitted(lateness.arrivals(vision, tracks), limits)))
    want = {r["period_ms"]: (r["n_events"], r["sum_delay_ms"]) for r in whole.collect()}
    assert {r["hour"]: (r["n_events"], r["sum_delay_ms"]) for r in state.hours().collect()} == want
    summed = {}
    for r in sent:
        n, d = summed.get(r["hour_ms"], (0, 0))
        summed[r["hour_ms"]] = n + r["sign"] * r["n_events"], d + r["sign"] * r["sum_delay_ms"]
    assert summed == want and any(r["sign"] < 0 for r in sent)
    # what a version retracts is what the one before asserted
    said = {(r["hour_ms"], r["version"], r["sign"]): r["n_events"] for r in sent}
    assert all(said[h, k - 1, 1] == n for (h, k, s), n in said.items() if s < 0)
    # a batch that comes again changes nothing, also for one who opens the folder anew
    again = lateness.HourlyState(limits, str(tmp_path / "state"))
    assert again.apply(lateness.copies(vision, tracks), "b0").count() == 0


def test_versions_in_order_equal_one_run(spark, tmp_path):
    """Where batches end with epochs and every first copy has its time, the versions are the same too."""
    rng = random.Random(9)
    v = [(f"e{i}", "vehicle_passage", t := BASE + rng.randrange(H), t + rng.choice([1, 1000, H, H + 400_000])) for i in range(200)]
    _, sent = in_batches(spark, tmp_path, v, [BASE + H, BASE + H + 300_000, BASE + H + 600_000])
    vision, tracks, limits = frames(spark, v)
    one = lateness.deltas(lateness.admitted(lateness.arrivals(vision, tracks), limits))
    assert sorted(map(tuple, sent)) == sorted(map(tuple, one.collect()))


def test_state_that_forgets_stays_right_for_events_in_time(spark, tmp_path):
    v = [("a", "vehicle_passage", BASE + 1, BASE + 2), ("b", "vehicle_passage", BASE + 5 * H, BASE + 5 * H + 1), ("a", "vehicle_passage", BASE + 1, BASE + 6 * H)]
    state, sent = in_batches(spark, tmp_path, v, [BASE + 10, BASE + 5 * H + 10], forget=True)
    assert {r["event_id"] for r in state.events().collect()} == {"b"} and [r["sign"] for r in sent] == [1, 1]
    assert sorted((r["hour"], r["n_events"]) for r in state.hours().collect()) == [(BASE - BASE % H, 1), (BASE + 5 * H - (BASE + 5 * H) % H, 1)]
