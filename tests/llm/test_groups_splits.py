import random

import numpy as np
import pytest

from tests.conftest import rows
from wayfold.llm import groups, splits

from .conftest import manifest


def components(n, links):
    root = list(range(n + 1))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n + 1)]


@pytest.mark.parametrize("shape", ["random", "chain", "star", "both"])
def test_hash_to_min(spark, shape):
    rng = random.Random(4)
    n = 300
    links = {"random": [(rng.randint(1, n), rng.randint(1, n)) for _ in range(220)], "chain": [(i, i + 1) for i in range(1, n)], "star": [(n, i) for i in range(1, n)]}
    links["both"] = links["chain"][:100] + [(250, i) for i in range(150, 250)] + links["chain"][:50]
    pairs = links[shape]
    found = components(n, pairs)
    want = sorted((x, found[x]) for x in {v for p in pairs if p[0] != p[1] for v in p})
    df = spark.createDataFrame([*pairs, (None, 1), (5, None), (7, 7)], "a long, b long")
    assert sorted(rows(groups.hash_to_min(df))) == want


def test_pointers_in_any_spelling(spark):
    at = lambda i: f"crops/a/{i:02x}.jpg"
    data = [{"image_path": at(i)} for i in range(1, 11)]
    data[1]["stage177_exact_duplicate_of"] = ".\\crops\\a\\01.JPG"
    data[2]["stage177_near_duplicate_of"] = " crops//a/02.jpg "
    data[4]["stage177_near_duplicate_of"] = "crops/gone/00.jpg"
    data[5]["stage177_exact_duplicate_of"] = at(6)  # its own row
    data[6]["stage177_exact_duplicate_of"] = "none"
    data[8].update(stage177_exact_duplicate_of=at(10), stage177_near_duplicate_of=at(8))
    m = manifest(spark, data)
    assert sorted(rows(groups.linked_rows(m))) == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8), (10, 8)]
    out = {r["stage177_row_number"]: (r["group_id"], r["group_size"]) for r in groups.grouped_rows(m).collect()}
    assert out[3] == (1, 3) and out[5] == (5, 1) and len(out) == 10
    assert groups.linked_rows(manifest(spark, [])).count() == 0


def sample(n=600):
    rng = random.Random(8)
    return [
        {
            "track_group": rng.choice([f"t{rng.randrange(400)}", None, "NULL"]), "source_group": rng.choice([f"S{rng.randrange(200)} ", "", "unknown"]), "camera_id": "hot" if i % 3 == 0 else rng.choice([f"c{rng.randrange(300)}", "-"]),
            "split": rng.choice(["train"] * 9 + ["test", "VAL ", None]), "body_type": rng.choice(["suv", "van", "bus"]),
        }
        for i in range(n)
    ]


def linked(data):
    key = lambda v: (v or "").strip().lower() if (v or "").strip().lower() not in ("", "null", "unknown", "-") else None
    first, links = {}, []
    for i, r in enumerate(data, 1):
        for k in splits.KEYS:
            if key(r[k]):
                links.append((first.setdefault((k, key(r[k])), i), i))
    return components(len(data), links)


def test_torn_rows(spark):
    data = sample()
    found = linked(data)
    held = {}
    for i, r in enumerate(data, 1):
        s = {"val": "validation"}.get((r["split"] or "").strip().lower(), (r["split"] or "").strip().lower())
        held.setdefault(found[i], set()).add(s or None)
    want = [i for i in range(1, len(data) + 1) if len(held[found[i]] - {None}) > 1]
    assert sorted(r[0] for r in rows(splits.torn_rows(manifest(spark, data)))) == want


def test_splits_keep_sets_and_meet_shares(spark):
    data = [r | {"camera_id": None if r["camera_id"] == "hot" else r["camera_id"], "source_group": None} for r in sample(1500)]
    found = linked(data)
    targets = spark.createDataFrame([("Train", 0.7), ("val", 0.15), ("test", 0.15)], "split string, target_share double")
    out = {r["stage177_row_number"]: r["new_split"] for r in splits.assigned_rows(manifest(spark, data), targets, block_sets=60).collect()}
    assert len(out) == 1500
    by_set = {}
    for i, s in out.items():
        by_set.setdefault(found[i], set()).add(s)
    assert all(len(s) == 1 for s in by_set.values())
    for r in splits.reached_shares(manifest(spark, data), targets).collect():
        assert abs(r["reached_share"] - r["target_share"]) < 0.02, r


def test_one_set_or_none(spark):
    targets = spark.createDataFrame([("train", 0.7), ("test", 0.3)], "split string, target_share double")
    one = manifest(spark, [{"camera_id": "c"}] * 20)
    assert {r["new_split"] for r in splits.assigned_rows(one, targets).collect()} == {"train"}
    assert splits.assigned_rows(manifest(spark, []), targets).count() == 0
    assert splits.torn_rows(manifest(spark, [])).count() == 0
    with pytest.raises(ValueError):
        splits.assigned_rows(one, spark.createDataFrame([], "split string, target_share double"))


def test_annealing_never_worsens():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 30, 200).astype(float)
    labels = np.zeros((200, 12))
    labels[np.arange(200), rng.integers(0, 3, 200)] = sizes
    share = np.array([0.7, 0.15, 0.15])
    start = rng.integers(0, 3, 200)
    energy = lambda s: sum((sizes[s == k].sum() - share[k] * sizes.sum()) ** 2 for k in range(3))
    out = splits.anneal(sizes, labels, share * sizes.sum(), share[:, None] * labels.sum(0), start, 1)
    assert energy(out) < energy(start) / 1000


def test_repeated_rows(spark):
    twice = [{"stage177_row_number": i, "image_path": f"p/{i}.jpg", "camera_id": "c", "split": "train" if i == 1 else "test", "stage177_near_duplicate_of": "p/1.jpg"} for i in (1, 2, 3) for _ in range(2)]
    m = manifest(spark, twice)
    assert rows(groups.linked_rows(m)) == [(1, 1), (2, 1), (3, 1)]
    assert rows(groups.grouped_rows(m)) == [(1, 1, 3), (2, 1, 3), (3, 1, 3)]
    assert rows(splits.torn_rows(m)) == [(1,), (2,), (3,)]
    targets = spark.createDataFrame([("train", 0.5), ("test", 0.5)], "split string, target_share double")
    assert splits.assigned_rows(m, targets).count() == 6


def test_repeated_rows_with_three_keys(spark):
    # row 4 alone links the others, row 2 by its middle key, and occurs twice
    links = {"stage177_row_number": 4, "track_group": "t", "source_group": "s", "camera_id": "c", "split": "train"}
    ends = [{"track_group": "t", "split": "train"}, {"source_group": "s", "split": "test"}, {"camera_id": "c", "split": "train"}]
    m = manifest(spark, [*ends, links, links])
    assert rows(splits.torn_rows(m)) == [(1,), (2,), (3,), (4,)]
    assert {r["set_id"] for r in splits.row_sets(m).collect()} == {1}


def test_every_label_has_a_count_of_its_own(spark):
    """Labels are balanced one by one, the rarest together; the report says how far each is from its target."""
    rng = random.Random(4)
    data = [{"camera_id": f"c{rng.randrange(900)}", "body_type": rng.choice(["suv", "heavy_truck", "light_truck", "sedan", "van", "bus", None])} for _ in range(6000)]
    targets = spark.createDataFrame([("train", 0.7), ("val", 0.15), ("test", 0.15)], "split string, target_share double")
    m = manifest(spark, data)
    report = splits.label_report(m, targets).collect()
    assert len(report) == 7 * 3 and sum(r["n_rows"] for r in report) == 6000
    assert max(abs(r["deviation"]) for r in report) < 0.02
    assert tuple(splits.invariants(m, targets).first()) == (6000, len({r["camera_id"] for r in data}), 0, 0, True)
    few = splits.label_numbers(splits.row_sets(m), 3)
    assert len(few) == 3 and set(few.values()) == {0, 1, 2}
