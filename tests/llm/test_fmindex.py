import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wayfold.llm.fmindex import FMIndex, expand

table = lambda least, most: st.integers(1, 4).flatmap(lambda w: st.tuples(*[st.lists(st.lists(st.integers(1, 5), min_size=w, max_size=w), min_size=n, max_size=12) for n in (least, most)]))


@settings(max_examples=150, deadline=None)
@given(table(1, 1))
def test_longest_suffix_and_its_places(both):
    records, patterns = np.array(both[0], np.int64), np.array(both[1], np.int64)
    index = FMIndex(records)
    matched, low, high = index.search(patterns)
    for k, p in enumerate(patterns.tolist()):
        found = [(r, i) for r, rec in enumerate(records.tolist()) for i in range(len(rec))]
        best = max((n for n in range(1, len(p) + 1) if any(records[r].tolist()[i : i + n] == p[-n:] for r, i in found)), default=0)
        assert matched[k] == best
        places = sorted(r for r, i in found if best and records[r].tolist()[i : i + best] == p[-best:])
        assert sorted(index.record[low[k] : high[k]].tolist()) == places


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 30)), max_size=15), st.integers(1, 8))
def test_expand(intervals, most):
    low = np.array([a for a, _ in intervals], int)
    high = np.array([a + n for a, n in intervals], int)
    got = [(int(r), int(a)) for rows, at in expand(low, high, most) for r, a in zip(rows, at, strict=True)]
    assert got == [(i, k) for i, (a, n) in enumerate(intervals) for k in range(a, a + n)]


def test_empty():
    index = FMIndex(np.empty((0, 3), np.int64))
    assert index.search(np.array([[1, 2, 3]]))[0].tolist() == [0]
