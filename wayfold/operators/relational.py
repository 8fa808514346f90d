"""Paging, picks, mutations and joins that more than one query needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 1000, farthest: int = 1_000_000) -> DataFrame:
    """Rows offset.. of a total order. limit is clamped to 1..most, offset to 0..farthest.

    The order has to be total for the page to be the same at every run; callers end it with a unique column. Spark keeps
    offset + limit rows per partition, so nothing is sorted as a whole.
    """
    limit, offset = min(most, max(1, limit)), min(farthest, max(0, offset))
    return df.orderBy(*order).offset(offset).limit(limit)


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows per key; the rank filter is pushed below the shuffle as a group limit."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """All rows of both, one per key: those of new replace those of old, later versions earlier ones."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return first_per(both, keys, [F.desc("_new"), *version]).drop("_new")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """Rows of new whose key old lacks, one per key."""
    return first_per(new.join(old.select(*keys).distinct(), keys, "left_anti"), keys, version)


def inserted(old: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """new with outcome: 'inserted', 'unique_violation' (the key is held, or an earlier row of new has it) or
    'not_null_violation'. Rows without a key are told apart before the ranking, so they fill no window."""
    named = new.where(F.col(key).isNotNull()).withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    held = old.select(F.col(key).alias("_held")).where("_held is not null").distinct()
    out = named.join(held, F.col(key) == F.col("_held"), "left").withColumn("outcome", F.when((F.col("_k") > 1) | F.col("_held").isNotNull(), "unique_violation").otherwise("inserted"))
    return out.drop("_k", "_held").unionByName(new.where(F.col(key).isNull()).withColumn("outcome", F.lit("not_null_violation")))


def compare_and_set(rows: DataFrame, changes: DataFrame, key: str, version: str, columns: list[str]) -> DataFrame:
    """changes: key, expected version, new values. Per change: key, outcome, new version.

    outcome: 'updated', 'conflict' (another version is stored) or 'not_found'.
    """
    r = rows.select(F.col(key).alias("_k"), F.col(version).alias("_v"))
    outcome = F.when(F.col("_k").isNull(), "not_found").when(F.col("_v") == F.col(f"expected_{version}"), "updated").otherwise("conflict")
    joined = changes.join(r, F.col(key) == F.col("_k"), "left")
    return joined.select(key, outcome.alias("outcome"), F.when(outcome == "updated", F.col("_v") + 1).otherwise(F.col("_v")).alias(version), *columns)


def moved(rows: DataFrame, transitions: DataFrame, key: str, state: str) -> DataFrame:
    """transitions: from_state, to_state. Every row with its next state, or its own where no transition starts there."""
    t = transitions.select(F.col("from_state").alias("_from"), F.col("to_state").alias("_to"))
    return rows.join(t, F.col(state) == F.col("_from"), "left").withColumn(f"next_{state}", F.coalesce("_to", state)).drop("_from", "_to")


def split_expired(rows: DataFrame, key: list[str], expires: str, now: Column, limit: int, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(expired, kept): the oldest `limit` rows with expires <= now, and the rest by an anti-join on the key."""
    expired = rows.where(F.col(expires) <= now).orderBy(*order).limit(limit)
    return expired, rows.join(expired.select(*key), key, "left_anti")


def sums_before(df: DataFrame, keys: list[str], time: str, order: list[Column], value: Column, descending: bool = False, bucket_ms: int = 3_600_000, bucket: Column | None = None) -> DataFrame:
    """df with _before, the sum of value over the rows of the group that come earlier in the order, and _total.

    The order begins with `time` in milliseconds (descending or not; nulls as Spark puts them) and is total. Groups are cut
    into buckets of time: sums per group and bucket, of which there are few, tell what lies before a bucket, and only
    within a bucket are rows put in order; so a group with a third of all rows is spread over its buckets.
    bucket: in place of the time any long that rises with the order; then `time` is not looked at.
    """
    bucket = F.coalesce(F.floor(F.col(time) / bucket_ms).cast("long") if bucket is None else bucket, F.lit(-(1 << 62)))
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    group = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))])
    sums = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b")).agg(F.sum("_value").alias("_sum"))
    upto = group.orderBy(F.desc("_b") if descending else F.asc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_ahead", F.coalesce(F.sum("_sum").over(upto), F.lit(0))).withColumn("_total", F.sum("_sum").over(group)).drop("_sum")
    same = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_ahead") + F.coalesce(F.sum("_value").over(within), F.lit(0))
    return rows.join(sums, same).withColumn("_before", before).drop("_bucket", "_value", "_b", "_ahead", *[f"_k{i}" for i in range(len(keys))])


def hash_rank(df: DataFrame, keys: list[str], digest: str, order: list[Column]) -> DataFrame:
    """df with _rank from 1 by the order, which begins with a hexadecimal digest: its first digits make the buckets, so a
    label with a third of all rows is put in order in 65,536 parts."""
    first = F.conv(F.substring(digest, 1, 4), 16, 10).cast("long")
    return sums_before(df, keys, "", order, F.lit(1), bucket=first).withColumn("_rank", F.col("_before") + 1).drop("_before", "_total")


def retention_candidates(frames: DataFrame, policies: DataFrame, now_ms: Column, limit: int | None = None) -> DataFrame:
    """Frames older than their task's retention, or beyond its number of frames, oldest first.

    frames: frame_id, task_id, capture_time_ms, save_time_ms; policies: task_id, retention_days, max_saved_frames. Newest
    frames rank first: by capture, save and id descending.
    """
    j = frames.join(policies.select("task_id", "retention_days", "max_saved_frames"), "task_id")
    newest = [F.desc("capture_time_ms"), F.desc("save_time_ms"), F.desc("frame_id")]
    ranked = sums_before(j, ["task_id"], "capture_time_ms", newest, F.lit(1), descending=True).withColumn("position", (F.col("_before") + 1).cast("long")).drop("_before", "_total")
    old = F.col("capture_time_ms") < now_ms - F.col("retention_days").cast("long") * 86_400_000
    found = ranked.where(old | (F.col("position") > F.col("max_saved_frames")))
    if limit is not None:
        found = found.orderBy("capture_time_ms", "save_time_ms", "frame_id").limit(min(10_000, max(1, limit)))
    return found


def pressure_sweep(frames: DataFrame, target: Column, size: str = "size_bytes", group: list[str] | None = None) -> DataFrame:
    """The oldest frames whose removal brings each group's total down to `target` bytes: deleted while what precedes them
    is less than the excess. Missing sizes count as 0."""
    order = [F.col(c) for c in ("capture_time_ms", "save_time_ms", "frame_id")]
    f = sums_before(frames, group or ["task_id"], "capture_time_ms", order, F.coalesce(F.col(size), F.lit(0)))
    return f.where(F.col("_before") < F.col("_total") - target).drop("_before", "_total")


def sticky_shards(keys: DataFrame, held: DataFrame, shards: int, key: str, order: str) -> DataFrame:
    """key, shard, held: keys that have a shard keep it; the others, in their order, go to the least loaded shard, and among
    equally loaded ones to the lowest first.

    In closed form: a shard offers a slot on every level from its load up, and the k-th new key takes the k-th slot by
    level and shard. Slots are made for as many levels as there are new keys; new keys are ranked in one task, as they
    are cameras or workers, not events. held: key, shard.
    """
    fresh = keys.join(held.select(key), key, "left_anti").select(key, F.row_number().over(Window.orderBy(order, key)).alias("_k"))
    loads = keys.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(held.groupBy("shard").agg(F.count("*").alias("_load")), "shard", "left").select("shard", F.coalesce("_load", F.lit(0)).alias("_load"))
    most = loads.agg(F.max("_load").alias("_most")).crossJoin(fresh.agg(F.count("*").alias("_new")))  # one row
    levels = loads.crossJoin(most).select("shard", F.explode(F.sequence(F.col("_load"), F.col("_most") + F.col("_new"))).alias("_level"))
    slots = levels.select("shard", F.row_number().over(Window.orderBy("_level", "shard")).alias("_k"))
    return held.select(key, "shard", F.lit(True).alias("held")).union(fresh.join(slots, "_k").select(key, "shard", F.lit(False)))


def overridden(rows: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """rows with the columns of the review of the same key in place of their own, where the review has a value.

    Raises ValueError if a review has no row, naming the first keys. Reviews are unique by key.
    """
    missing = [r[0] for r in reviews.select(key).join(rows.select(key), key, "left_anti").orderBy(key).limit(5).collect()]
    if missing:
        raise ValueError(f"reviews without a row: {missing}")
    named = reviews.select(key, *[F.col(c).alias(f"_new_{c}") for c in reviews.columns if c != key])
    return rows.join(named, key, "left").select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in reviews.columns and c != key else F.col(c) for c in rows.columns])
