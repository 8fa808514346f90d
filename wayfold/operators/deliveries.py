"""Problem 3: messages delivered at least once, kept exactly once.

Deliveries are upserted into storage that is bucketed by the hash of the identifier and sorted by it within a bucket. An
upsert is a batch with a name and adds a run: per bucket one sorted file in which an identifier occurs once. The store
keeps a ledger of the batches it holds, published by one rename after the run is written: a batch that comes again, or
again after a failure, adds nothing, neither rows nor copies. Compaction merges the sorted runs of a bucket two by two,
as a merge join on equal identifiers, which collapse into one row; it needs neither a shuffle nor a sort, and its output
is again one sorted file per bucket. Which copy wins is a total order over the columns, so the order of batches changes
nothing. A store lives in its folder and can be opened again; one writer at a time.

How it scales. A run is first reduced by identifier with partial aggregates, so an identifier that makes up a third of
all deliveries is a few rows before it reaches its bucket. Buckets are counted from the first upsert, about BUCKET_ROWS
deliveries each, and stay with the store. Runs are written to the shared folder.

Deliveries without an identifier (null, blank or a filler word) are never merged: each stays a row of its own. Nulls in
the ordering columns rank lowest. Repeated rows of one batch count as copies. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normal
from ..session import Scratch, read_text, remove, write_text

#: Deliveries per bucket for which a new store is laid out, and the least number of its buckets.
BUCKET_ROWS, LEAST_BUCKETS = 500_000, 4
_SORTED_SCAN = "spark.sql.legacy.bucketedTableScan.outputOrdering"
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"

#: Per table: the identifier, and the columns by which the winning copy is the greatest.
OUTBOX = ("event_id", ("attempt", "updated_at_ms", "delivered_at_ms", "outbox_id", "status", "ingest_batch"))
COMMANDS = ("message_id", ("delivered_at_ms", "definition_version", "create_time_ms", "worker_consumer", "ingest_batch"))
#: What else a message holds; copies that tie on the ordering columns are told apart by these, in turn.
OUTBOX_REST = ("event_id", "callback_profile", "next_attempt_at_ms", "last_attempt_at_ms", "last_http_status", "last_error_code", "response_body_hash", "created_at_ms")
COMMANDS_REST = (
    "message_id", "command_kind", "task_id", "run_id", "camera_profile", "frame_interval_ms", "output_mode", "jpeg_quality", "retention_days", "target_infer_fps",
    "algorithm_profile", "callback_profile", "origin", "algorithms",
)



class DeliveryStore:
    """Bucketed, sorted storage of one kind of message, in a folder that all executors share.

    buckets: by default those of the store that is in the folder, else counted from the first upsert.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        held = read_text(spark, f"{self.folder}/_ledger.json")
        self.ledger = json.loads(held) if held else {"buckets": buckets, "schema": None, "runs": []}

    def _publish(self, runs: list[dict]) -> None:
        self.ledger["runs"] = runs
        write_text(self.spark, f"{self.folder}/_ledger.json", json.dumps(self.ledger))

    def batches(self) -> set[str]:
        """The names of all batches held."""
        return {b for run in self.ledger["runs"] for b in run["batches"]}

    def upsert(self, deliveries: DataFrame, batch: str) -> bool:
        """Adds a batch; False if it is held already. deliveries: key, copy (a struct that begins with the ordering columns)."""
        return bool(self.upsert_all(deliveries.withColumn("batch", F.lit(batch)), [batch]))

    def upsert_all(self, deliveries: DataFrame, batches: list[str]) -> list[str]:
        """Adds several batches in one pass over the deliveries, which name theirs in the column batch. Returns the new ones."""
        new = [b for b in batches if b not in self.batches()]
        if not new:
            return []
        if not self.ledger["buckets"]:
            self.ledger["buckets"] = max(LEAST_BUCKETS, -(-deliveries.count() // BUCKET_ROWS))
        n = self.ledger["buckets"]
        number = F.create_map(*[x for i, b in enumerate(new) for x in (F.lit(b), F.lit(i))])
        mine = deliveries.where(F.col("batch").isin(new)).groupBy(number[F.col("batch")].alias("run"), "key").agg(F.max("copy").alias("copy"), F.count("*").alias("copies"))
        self.ledger["schema"] = mine.drop("run").schema.json()
        at = f"{self.folder}/{uuid.uuid4().hex[:12]}"
        name = f"wayfold_{uuid.uuid4().hex}"
        try:
            mine.repartition(n, "key").write.format("parquet").option("path", at).partitionBy("run").bucketBy(n, "key").sortBy("key").saveAsTable(name)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._publish([*self.ledger["runs"], *[{"path": f"{at}/run={i}", "batches": [b]} for i, b in enumerate(new)]])
        return new

    def _declare(self, path: str) -> str:
        """A name by which the run in a folder can be read as bucketed and sorted."""
        from pyspark.sql.types import StructType

        name = f"wayfold_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(self.ledger["schema"])))
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.ledger['buckets']} BUCKETS LOCATION '{path}'")
        return name

    def merge_of(self, left: str, right: str) -> DataFrame:
        """key, copy, copies of two declared runs: a merge join of sorted buckets."""
        a, b = (self.spark.table(t).select("key", F.col("copy").alias(f"{s}_copy"), F.col("copies").alias(f"{s}_copies")) for t, s in ((left, "a"), (right, "b")))
        both = a.hint("merge").join(b, "key", "full")
        copies = F.coalesce("a_copies", F.lit(0)) + F.coalesce("b_copies", F.lit(0))
        return both.select("key", F.greatest("a_copy", "b_copy").alias("copy"), copies.cast("long").alias("copies"))

    def compact(self) -> None:
        """Merges runs, the smallest number of batches first, until one is left; each merge is published by itself."""
        conf, n = self.spark.conf, self.ledger["buckets"]
        before = {k: conf.get(k, None) for k in (_SORTED_SCAN, _WRITERS)}
        conf.set(_SORTED_SCAN, "true")
        # A task of the merge writes one bucket in order, so that the writer need not sort what it gets.
        conf.set(_WRITERS, "2")
        try:
            while len(self.ledger["runs"]) > 1:
                first, second, *rest = sorted(self.ledger["runs"], key=lambda r: len(r["batches"]))
                names = [self._declare(r["path"]) for r in (first, second)]
                at, name = f"{self.folder}/{uuid.uuid4().hex[:12]}", f"wayfold_{uuid.uuid4().hex}"
                try:
                    self.merge_of(*names).write.format("parquet").option("path", at).bucketBy(n, "key").saveAsTable(name)
                finally:
                    for t in (*names, name):
                        self.spark.sql(f"DROP TABLE IF EXISTS {t}")
                self._publish([*rest, {"path": at, "batches": first["batches"] + second["batches"]}])
                for r in (first, second):
                    remove(self.spark, r["path"])
        finally:
            for k, v in before.items():
                conf.set(k, v) if v is not None else conf.unset(k)

    def messages(self) -> DataFrame:
        """key, copy, copies of all batches, each key once. Compacts first if there are several runs."""
        from pyspark.sql.types import StructType

        self.compact()
        return self.spark.read.schema(StructType.fromJson(json.loads(self.ledger["schema"]))).parquet(*[r["path"] for r in self.ledger["runs"]])


def _copies(deliveries: DataFrame, identifier: str, order: tuple[str, ...], rest: tuple[str, ...]) -> DataFrame:
    named = [F.col(c) for c in order] + [F.col(c) for c in rest]
    return deliveries.select(normal.key(identifier).alias("key"), F.struct(*named).alias("copy"), F.col("ingest_batch").alias("batch")).where("key is not null")


def merged(deliveries: DataFrame, identifier: str, order: tuple[str, ...], columns: tuple[str, ...] = (), runs: int = 3, scratch: Scratch | None = None, store: DeliveryStore | None = None) -> DataFrame:
    """key, n_copies and the ordering and other columns of the one copy kept per identifier.

    The batches are upserted in `runs` runs, each holding whole batches, as they would come in over time. store: where
    they go; what it holds already counts too. By default a new store in the scratch folder.
    """
    rest = tuple(c for c in columns if c not in order)
    store = store or DeliveryStore(deliveries.sparkSession, (scratch or Scratch(deliveries.sparkSession, "deliveries")).path("store"))
    part = F.concat(F.lit("run-"), F.pmod(F.xxhash64(F.coalesce("batch", F.lit(""))), F.lit(runs)))
    store.upsert_all(_copies(deliveries, identifier, order, rest).withColumn("batch", part), [f"run-{i}" for i in range(runs)])
    return store.messages().select("key", F.col("copies").alias("n_copies"), "copy.*")


def repeated(tables: dict[str, tuple[DataFrame, tuple[str, tuple[str, ...]]]], scratch: Scratch | None = None) -> DataFrame:
    """table_name, message_key of identifiers that came in two or more rows."""
    out = None
    for name, (df, (identifier, order)) in tables.items():
        found = merged(df, identifier, order[:1], scratch=scratch).where("n_copies > 1").select(F.lit(name).alias("table_name"), F.col("key").alias("message_key"))
        out = found if out is None else out.union(found)
    return out


def kept_once(deliveries: DataFrame, identifier: str, order: tuple[str, ...], columns: tuple[str, ...] = (), scratch: Scratch | None = None) -> DataFrame:
    """One row per identifier, and every row without one: message_key, n_copies, the columns."""
    names = [*order, *[c for c in columns if c not in order]]
    once = merged(deliveries, identifier, order, columns, scratch=scratch).select(F.col("key").alias("message_key"), "n_copies", *names)
    alone = deliveries.where(normal.key(identifier).isNull()).select(F.lit(None).cast("string").alias("message_key"), F.lit(1).cast("long").alias("n_copies"), *names)
    return once.union(alone)
