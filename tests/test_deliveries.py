import pytest

from wayfold.operators import deliveries
from wayfold.plans.catalog import core

from .conftest import rows

SCHEMA = "event_id string, attempt int, updated_at_ms long, delivered_at_ms long, outbox_id long, status string, ingest_batch string, key string, copy int"


def table(spark, data):
    return spark.createDataFrame([(*r, "k", 1) for r in data], SCHEMA)


DATA = [
    ("e1", 1, 10, None, 1, "retry", "b1"),
    (" E1", 2, 5, None, 1, "delivered", "b2"),
    ("e1 ", 2, 7, 9, 9, "delivered", "b3"),
    ("e2", None, None, None, 2, None, None),
    ("e2", None, None, None, 2, None, None),
    (None, 1, 1, 1, 3, "x", "b1"),
    ("none", 1, 1, 1, 4, "x", "b1"),
    ("", 1, 1, 1, 5, "x", "b1"),
    ("e3", 0, 1, 1, 6, "x", "b1"),
]


def test_one_copy_wins_and_missing_identifiers_stay(spark):
    out = deliveries.kept_once(table(spark, DATA), *deliveries.OUTBOX)
    got = {(r["message_key"], r["outbox_id"]): (r["n_copies"], r["attempt"], r["updated_at_ms"]) for r in out.collect()}
    assert got == {("e1", 9): (3, 2, 7), ("e2", 2): (2, None, None), ("e3", 6): (1, 0, 1), (None, 3): (1, 1, 1), (None, 4): (1, 1, 1), (None, 5): (1, 1, 1)}


def test_order_and_repetition_of_batches_do_not_matter(spark):
    a = deliveries.kept_once(table(spark, DATA), *deliveries.OUTBOX)
    b = deliveries.kept_once(table(spark, DATA[::-1]), *deliveries.OUTBOX)
    assert rows(a) == rows(b)


def copies(spark, data):
    return deliveries._copies(table(spark, data), "event_id", ("attempt",), ()).drop("batch")


def held(store):
    return sorted((r["key"], r["copy"]["attempt"], r["copies"]) for r in store.messages().collect())


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    store = deliveries.DeliveryStore(spark, str(tmp_path / "store"), buckets=3)
    assert store.upsert(copies(spark, DATA), "monday") and not store.upsert(copies(spark, DATA), "monday")
    want = [("e1", 2, 3), ("e2", None, 2), ("e3", 0, 1)]
    assert held(store) == want
    assert not store.upsert(copies(spark, DATA), "monday") and held(store) == want  # after compaction too
    assert store.upsert(copies(spark, [("E3", 5, 1, 1, 6, "x", "b1"), ("e4", 1, 1, 1, 6, "x", "b1")]), "tuesday")
    assert held(store) == [("e1", 2, 3), ("e2", None, 2), ("e3", 5, 2), ("e4", 1, 1)]


def test_a_store_outlives_the_query(spark, tmp_path):
    at = str(tmp_path / "store")
    once = deliveries.merged(table(spark, DATA), *deliveries.OUTBOX, store=deliveries.DeliveryStore(spark, at))
    first = rows(once)
    again = deliveries.DeliveryStore(spark, at)
    assert again.ledger["buckets"] == deliveries.LEAST_BUCKETS and again.batches() == {"run-0", "run-1", "run-2"}
    assert rows(deliveries.merged(table(spark, DATA), *deliveries.OUTBOX, store=again)) == first
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("wayfold_")]


def test_a_run_that_was_not_published_counts_for_nothing(spark, tmp_path, monkeypatch):
    store = deliveries.DeliveryStore(spark, str(tmp_path / "store"), buckets=2)
    with monkeypatch.context() as m:
        m.setattr(store, "_publish", lambda runs: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.upsert(copies(spark, DATA), "monday")
    again = deliveries.DeliveryStore(spark, str(tmp_path / "store"), buckets=2)
    assert again.batches() == set() and again.upsert(copies(spark, DATA), "monday")
    assert held(again) == [("e1", 2, 3), ("e2", None, 2), ("e3", 0, 1)]


def test_compaction_merges_sorted_runs(spark, tmp_path):
    """Neither a shuffle nor a sort; and the result is sorted within its buckets."""
    store = deliveries.DeliveryStore(spark, str(tmp_path / "store"), buckets=3)
    many = [(f"e{i % 700}", i, 1, 1, i, "x", "b") for i in range(1500)]
    for k in range(3):
        store.upsert(copies(spark, many[k::3]), f"b{k}")
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    names = [store._declare(r["path"]) for r in store.ledger["runs"][:2]]
    plan = store.merge_of(*names)._jdf.queryExecution().executedPlan().toString()
    for n in names:
        spark.sql(f"DROP TABLE {n}")
    spark.conf.unset("spark.sql.legacy.bucketedTableScan.outputOrdering")
    assert "Exchange" not in plan and "Sort " not in plan and "SortMergeJoin" in plan
    assert held(store) == sorted((f"e{i}", max(j for j in range(1500) if j % 700 == i), sum(j % 700 == i for j in range(1500))) for i in range(700))
    files = store.messages().select("_metadata.file_name", "key").rdd.map(tuple).collect()
    by = {}
    for name, key in files:
        by.setdefault(name, []).append(key)
    assert len(by) == 3 and all(k == sorted(k) for k in by.values())


def test_empty_and_repeated(spark):
    assert deliveries.kept_once(table(spark, []), *deliveries.OUTBOX).count() == 0
    found = deliveries.repeated({"callback_outbox": (table(spark, DATA), deliveries.OUTBOX)})
    assert rows(found) == [("callback_outbox", "e1"), ("callback_outbox", "e2")]


def test_hot_identifier(spark):
    hot = [("hot", i % 7, i, None, i, "x", f"b{i % 5}") for i in range(3000)] + [(f"c{i}", 1, 1, 1, i, "x", "b1") for i in range(100)]
    out = {r["message_key"]: (r["n_copies"], r["attempt"]) for r in deliveries.kept_once(table(spark, hot), *deliveries.OUTBOX).collect()}
    assert len(out) == 101 and out["hot"] == (3000, 6)


@pytest.mark.parametrize(("name", "source"), [("p3_outbox_messages", "callback_outbox"), ("p3_commands_messages", "camera_task_commands")])
def test_the_whole_message_is_kept(spark, name, source):
    at = "/root/testdata/sf0.001"
    messages = spark.read.parquet(f"{at}/{source}.parquet")
    out = core.queries[name](spark, at)
    assert set(out.columns) == {"message_key", "n_copies", *messages.columns}
    # no message is put together from several copies
    assert out.select(*messages.columns).exceptAll(messages).count() == 0
    short = core.queries[name.replace("messages", "once")](spark, at)
    assert rows(out.select(*short.columns)) == rows(short)


def test_copies_that_tie_on_the_order_are_told_apart(spark):
    tied = spark.createDataFrame([(*DATA[0], "k", 1), (*DATA[0], "k", 0), (*DATA[0], "k", 3)], SCHEMA)
    for copies in (tied, tied.orderBy("copy")):
        out = deliveries.kept_once(copies, *deliveries.OUTBOX, ("copy",)).first()
        assert (out["n_copies"], out["copy"]) == (3, 3)
