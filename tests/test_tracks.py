import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wayfold.operators import tracks as T
from wayfold.plans.catalog import core

from .conftest import rows


def seen(*labels, c=0.95, q=1.0):
    return [(x, c, q) if isinstance(x, str) else x for x in labels]


def test_tracker_life_cycle():
    t = T.Tracker(least_hits=2, timeout=100)
    box = (0.1, 0.1, 0.9, 0.9)
    assert t.frame(1, 0, [box]) == ([1], []) and not t.active[0].confirmed
    assert t.frame(2, 10, [box]) == ([1], []) and t.active[0].confirmed
    assert t.frame(3, 20, [box], generation=2)[0] is None and t.rejected == 1
    found, gone = t.frame(3, 200, [])
    assert found == [] and [x.id for x in gone] == [1] and not t.active
    assert t.frame(3, 210, [box])[0] is None
    assert t.frame(4, 220, [(0.5, 0.5, 0.4, 0.9)])[0] is None


def test_queue():
    q = T.AdmissionQueue(2)
    for key, seq, quality in [(1, 1, 0.40), (1, 2, 0.80), (1, 1, 0.90), (2, 1, 0.50), (3, 1, 0.90)]:
        q.offer(key, seq, quality)
    assert (q.replaced, q.stale, q.evicted) == (1, 1, 1)
    assert q.take() == [3, 1] and not q.held


def test_fusion_adopts_switches_and_abstains():
    a = T.Aggregator({"body": 0.75, "color": 0.70})
    n = itertools.count(1)
    add = lambda body, color, q=1.0: a.add(next(n), q, body=(body, 0.95), color=(color, 0.95))
    for color in ("black", "white", "white"):
        add("suv", color)
    assert a.outcome("body")[0] == "suv" and a.outcome("color")[0] == "unknown"
    add("suv", "white")
    assert a.outcome("color")[0] == "white"
    out = []
    for _ in range(3):
        add("suv", "black")
        out.append(a.outcome("color")[0])
    assert out == ["white", "unknown", "black"] and a.heads["color"].switches == 1


def test_fusion_conflicts():
    a = T.Aggregator({"body": 0.75, "color": 0.70})
    for i, (b, c) in enumerate([("suv", "white")] * 3 + [("sedan", "black"), ("mpv", "red")], 1):
        a.add(i, 1.0, body=(b, 0.95), color=(c, 0.95))
    assert a.outcome("body")[0] == a.outcome("color")[0] == "unknown" and a.heads["body"].switches == 0
    a = T.Aggregator({"body": 0.75})
    for i, (b, q) in enumerate([("suv", 1.0)] * 3 + [("sedan", 0.1)] * 3, 1):
        a.add(i, q, body=(b, 0.95))
    assert a.outcome("body")[0] == "suv" and not a.add(3, 1.0, body=("suv", 0.9))


def test_guarded_fusion():
    f = lambda o, w=3, s=0.55, m=0.10: list(T.fuse_guarded(o, w, s, m))
    assert f(seen(*["sedan"] * 5)) == ["sedan"] * 5
    assert f(seen("suv", "suv", ("sedan", 0.95, 0.05), "suv")) == ["suv"] * 4
    assert f(seen("suv", *["sedan"] * 4), w=1) == ["suv", "suv", "unknown", "sedan", "sedan"]
    assert f(seen("suv", "sedan", "suv", "sedan"), s=0.70, m=0.40)[-1] == "unknown"


def test_frontier_hold():
    o = [("suv", 0.96, 1.0), ("unknown", 0, 0), ("unknown", 0, 0)]
    assert list(T.fuse_held(o, 5, 1, (0.5, 0.1), (0.6, 0.2), 2, hold=1)) == ["suv", "suv", "unknown"]


def test_short_tracks_never_have_lower_thresholds():
    o = [("suv", 0.6, 1.0)] * 2
    how = dict(window=5, least=1, entry=(0.5, 0.1), switch=(0.6, 0.2), patience=2)
    assert list(T.fuse_by_length(o, 3, {"suv": 0.5}, {"suv": 0.7}, 0.1, 1, **how)) == ["unknown"] * 2
    assert list(T.fuse_by_length(o * 3, 3, {"suv": 0.5}, {"suv": 0.55}, 0.1, 1, **how)) == ["suv"] * 6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20), min_size=3, max_size=3), min_size=1, max_size=4))
def test_optimal_matching_is_optimal(cost):
    c = np.array(cost, float)
    got = T.match_optimal(c, 100.0)
    n, m = c.shape
    best = min(sum(c[i, j] for i, j in zip(range(n), p, strict=False)) for p in itertools.permutations(range(m), n)) if n <= m else min(sum(c[i, j] for j, i in enumerate(p)) for p in itertools.permutations(range(n), m))
    assert len(got) == min(n, m) and abs(sum(c[i, j] for i, j in got) - best) < 1e-9


def test_optimal_matching_keeps_its_gate():
    assert T.match_optimal(np.array([[0.9, 0.1], [0.95, 0.2]]), 0.82) == [(0, 1)]


def test_small_folds():
    assert T.suppress([(0, 0, 1, 1), (0, 0, 1, 0.9), (0, 0, 1, 1)], [0.5, 0.9, 0.4], [0, 0, 1], 0.5) == [1, 2]
    assert list(T.fps_windows([1, 501, 1001, 1501, 2100])) == [(1, 1001, 3.0), (1001, 2100, 2 * 1000 / 1099)]
    assert list(T.at_cadence([0, 50, 120, 130, 500, 510], 100)) == [0, 2, 4]
    assert list(T.within_budget([5, 9, 3, 2], 10, 9)) == [0, 2, 3]
    assert T.separate_windows([1, 2, 3, 9], 3, 10) == [1, 9]
    assert list(T.leases([(0, "acquire", "a", 10), (5, "acquire", "b", 10), (6, "refresh", "a", 10), (17, "refresh", "a", 10), (18, "acquire", "b", 10), (19, "release", "a", 0), (20, "release", "b", 0)])) == [1, 0, 2, 0, 1, 0, 1]
    assert T.three_means(np.array([0.0, 1, 10, 11, 20, 21])) == [0.5, 10.5, 20.5]
    assert T.three_means(np.array([0.0, 10, 20]), np.array([1, 5, 2])) == [0.0, 10.0, 20.0]
    assert T.detection_outcomes([((0, 0, 1, 1), 0.5), ((0, 0, 1, 0.95), 0.9)], [(0, 0, 1, 1), (0.9, 0.9, 1, 1)], 0.5) == ["fp", "tp", "fn"]
    assert T.match_greedy([(0, 0, 1, 1)], [(0, 0, 1, 0.5), (0, 0, 1, 0.9)], 0.3)[0][:2] == (0, 1)
    assert T.predict((0, 0, 1, 1), (1, 0, 2, 1), 2.0, 4.0) == (3, 0, 4, 1)
    assert list(T.follow_in_order([(0, [(0, 0, 1, 1)]), (1, [(0, 0, 1, 0.9), (0.5, 0.5, 0.6, 0.6)]), (9, [(0, 0, 1, 1)])])) == [[1], [1, 2], [3]]


def test_streamed_fold_equals_a_plain_one(spark):
    d = spark.createDataFrame([(k, i, (i * 7) % 5) for k in ("a", "b", "c") for i in range(100)], "k string, i int, v int").repartition(5)

    def fold(rows):
        total = 0
        for k, i, v in rows:
            total += int(v)
            yield k, int(i), total

    out = {(r["k"], r["i"]): r["total"] for r in T.streamed(d, ["k"], ["i"], fold, "k string, i int, total long").collect()}
    assert out == {(k, i): sum((j * 7) % 5 for j in range(i + 1)) for k in "abc" for i in range(100)}


def test_photometric_clusters_are_those_of_the_values_themselves(spark, tmp_path):
    m = [("a", x) for x in ("10.40", "20.40", "30.40", "30.40", "dark", None)]
    spark.createDataFrame(m, "source_dataset string, stage177_mean_luma string").write.parquet(f"{tmp_path}/attribute_manifest.parquet")
    got = core.queries["r24_photometric_clusters"](spark, str(tmp_path))
    assert rows(got) == [("a", 0, 10.4), ("a", 1, 20.4), ("a", 2, 30.4)]


def test_cadence_drops_stale_frames_but_uses_their_due_time():
    assert list(T.at_cadence([0, 10, 20, 30], 10, [0, 99, 0, 0], 50)) == [0, 2, 3]
    assert list(T.at_cadence([0, 5, 25, 26, 30], 10)) == [0, 2, 4]


def test_batches_close_by_number_or_by_wait():
    assert list(T.micro_batches([0, 0, 1, 2, 3, 9], 3, 2)) == [0, 0, 0, 1, 1, 2]
    assert list(T.micro_batches([], 3, 2)) == []


def test_clusters_need_three_values():
    import numpy as np

    for values, weights in (([1.0, 2.0], None), ([1.0], [2]), ([1.0, 1.0, 1.0], None)):
        with pytest.raises(ValueError):
            T.three_means(np.array(values), None if weights is None else np.array(weights))
    assert T.three_means(np.array([1.0, 5.0, 9.0])) == [1.0, 5.0, 9.0]


def test_link_costs():
    box = (0.1, 0.1, 0.4, 0.4)
    same = T.link_cost(box, box, 1, 10, 0.0, 1)
    assert abs(same - 0.08 * 0.1) < 1e-12
    assert T.link_cost(box, box, 11, 10, 0.0, 1) is None and T.link_cost(box, box, 1, 10, 0.5, 1) is None
    assert T.link_cost(box, (0.1, 0.1, 0.9, 0.9), 1, 10, 0.0, 1) is None  # sides more than e^0.9 times as long
    assert T.link_cost(box, (0.2, 0.1, 0.5, 0.4), 1, 10, 0.2, 2) > same
