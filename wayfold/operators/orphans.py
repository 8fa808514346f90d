"""Problem 6: references to records that do not exist.

References are counted per key and period before anything is looked up. Keys that hold more than 1/`heavy_share` of all
references number fewer than `heavy_share` by arithmetic; those are broadcast to the target table and checked there. The
remaining keys are checked by a shuffled anti-join, in which no key is heavy any more. Both kinds of orphans are united.

A target that only came later than the reference does exist: such references are counted apart, not as orphans.

Nulls, blanks and filler words are no references. Repeated rows count as references each. A period is the UTC day of the
referring row; without a time it is null. Empty tables give empty results; with an empty target every reference is an
orphan. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normal
from ..session import Scratch

DAY_MS = 86_400_000
HEAVY_SHARE = 1000


def references(rows: DataFrame, table_name: str, column: str, target: str) -> DataFrame:
    """table_name, target, key, event_id, created, period (start of the UTC day, in ms)."""
    created = F.col("created_at_ms").cast("long")
    return rows.select(
        F.lit(table_name).alias("table_name"), F.lit(target).alias("target"), normal.key(column).alias("key"), normal.key("event_id").alias("event_id"),
        created.alias("created"), (created - F.pmod(created, F.lit(DAY_MS))).alias("period"),
    ).where("key is not null")


def targets(rows: DataFrame, target: str, column: str, arrival: str) -> DataFrame:
    """target, key, arrived: one row per row of the table."""
    return rows.select(F.lit(target).alias("target"), normal.key(column).alias("key"), F.col(arrival).cast("long").alias("arrived")).where("key is not null")


def orphan_counts(refs: DataFrame, held: DataFrame, scratch: Scratch | None = None, heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """table_name, target, key, period, n: the references per key and period whose key no target row has."""
    scratch = scratch or Scratch(refs.sparkSession, "orphans")
    counted = scratch.keep(refs.groupBy("table_name", "target", "key", "period").agg(F.count("*").alias("n")), "counted")
    total = counted.agg(F.sum("n")).first()[0] or 0
    per_key = counted.groupBy("target", "key").agg(F.sum("n").alias("all"))
    heavy = scratch.keep(per_key.where(F.col("all") > max(1, total // heavy_share)).select("target", "key"), "heavy")
    # Fewer than heavy_share keys can each hold more than that part of all references.
    found = scratch.keep(held.select("target", "key").join(F.broadcast(heavy), ["target", "key"], "left_semi").distinct(), "found")
    is_heavy = counted.join(F.broadcast(heavy), ["target", "key"], "left_semi")
    light = counted.join(F.broadcast(heavy), ["target", "key"], "left_anti")
    names = ["table_name", "target", "key", "period", "n"]
    missing_heavy = is_heavy.join(F.broadcast(found), ["target", "key"], "left_anti").select(*names)
    missing_light = light.join(held.select("target", "key").distinct(), ["target", "key"], "left_anti").select(*names)
    return scratch.keep(missing_heavy.union(missing_light), "orphans")


def orphan_events(refs: DataFrame, held: DataFrame, scratch: Scratch | None = None, heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """table_name, event_id: the events that refer to a key without any row."""
    missing = orphan_counts(refs, held, scratch, heavy_share).select("table_name", "target", "key").distinct()
    return refs.where("event_id is not null").join(missing, ["table_name", "target", "key"], "left_semi").select("table_name", "event_id").distinct()


def orphan_report(refs: DataFrame, held: DataFrame, scratch: Scratch | None = None, heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """table_name, period_ms, n_references, n_orphans, n_early: references, those to nothing, and those made before the
    first target row arrived."""
    scratch = scratch or Scratch(refs.sparkSession, "orphans")
    missing = orphan_counts(refs, held, scratch, heavy_share).groupBy("table_name", "period").agg(F.sum("n").alias("n_orphans"))
    # Compared per key and time of reference, so that repeated references at one time are one row.
    at = refs.groupBy("table_name", "target", "key", "period", "created").agg(F.count("*").alias("n"))
    first = held.groupBy("target", "key").agg(F.min("arrived").alias("arrived"))
    timed = at.join(first, ["target", "key"], "left")
    counts = timed.groupBy("table_name", "period").agg(F.sum("n").alias("n_references"), F.sum(F.when(F.col("created") < F.col("arrived"), F.col("n")).otherwise(0)).alias("n_early"))
    same = counts["table_name"].eqNullSafe(missing["table_name"]) & counts["period"].eqNullSafe(missing["period"])
    return counts.join(missing, same, "left").select(counts["table_name"], counts["period"].alias("period_ms"), "n_references", F.coalesce("n_orphans", F.lit(0)).cast("long").alias("n_orphans"), "n_early")


def observation_references(vision: DataFrame, alerts: DataFrame, tracks: DataFrame) -> DataFrame:
    return (
        references(vision, "vision_events", "evidence_frame_id", "camera_frames")
        .union(references(alerts, "security_alert_events", "evidence_frame_id", "camera_frames"))
        .union(references(tracks, "vehicle_track_results", "event_id", "vision_events"))
    )


def observation_targets(frames: DataFrame, vision: DataFrame) -> DataFrame:
    return targets(frames, "camera_frames", "frame_id", "save_time_ms").union(targets(vision, "vision_events", "event_id", "created_at_ms"))
