"""Problem 7: aggregates by event time that late records correct, up to a cut-off.

An event counts in the UTC hour of its event time. What arrives before the hour ends makes the hour's first version; each
later epoch that brings events within the allowed lateness makes a further one. Versions are sent on as deltas: the old
aggregate with sign -1 and the new one with sign +1. Whatever follows, such as totals by day, is a sum over signed
deltas and needs neither the events nor the earlier state. Events beyond the cut-off are kept apart.

The same is done in one run over all events (deltas) or batch by batch (HourlyState), where the state of an hour is its
version and aggregate, and a batch changes only what it touches: it retracts what an event counted before, if a copy of it
was seen with less knowledge, and asserts what it counts now. streaming/jobs.py has the form for streams.

How it scales. Copies of an event are reduced to the first by partial aggregates; versions come from sums per hour and
epoch, of which an hour has at most lateness/epoch, so the window that accumulates them sees few rows per hour whatever
the number of events. A kind or an hour with a third of all events is pre-aggregated like any other.

An event time in seconds, micro- or nanoseconds is read in the unit its size shows; null, 0 and negative times are
missing, and such events count nowhere. An event without an identifier is an event of its own. A kind without a limit has
none allowed (and no event of it is reported as too late). Nulls in arrival time are missing arrivals: not counted.
Empty tables give empty results.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal
from ..session import read_text, remove, write_text

HOUR_MS = 3_600_000
EPOCH_MS = 300_000
TRACK_KIND = "vehicle_passage"


def arrivals(vision: DataFrame, tracks: DataFrame) -> DataFrame:
    """table_name, event_id, kind, event_time, arrival: one row per event, at its first arrival.

    Of several copies the event time is that of the first copy that has one.
    """
    return known(sightings(copies(vision, tracks)))


def copies(vision: DataFrame, tracks: DataFrame) -> DataFrame:
    """table_name, event_id, kind, event_time, created of all rows of both tables."""
    v = vision.select(F.lit("vision_events").alias("table_name"), normal.key("event_id").alias("event_id"), normal.key("event_kind").alias("kind"), normal.epoch_ms("occurred_at_ms").alias("event_time"), F.col("created_at_ms").cast("long").alias("created"))
    t = tracks.select(F.lit("vehicle_track_results").alias("table_name"), normal.key("event_id").alias("event_id"), F.lit(TRACK_KIND).alias("kind"), normal.epoch_ms("last_seen_at_ms").alias("event_time"), F.col("created_at_ms").cast("long").alias("created"))
    return v.union(t)


def sightings(rows: DataFrame) -> DataFrame:
    """table_name, event_id, kind_at, time_at, arrival: one row per event, or one per row without an identifier.

    kind_at and time_at hold the first known kind and time, each after the arrival of its copy (copies that arrive at once
    are told apart by value). Sightings of one event can be merged again by least().
    """
    first = lambda c: F.when(F.col(c).isNotNull(), F.struct("created", c))
    named = rows.where("event_id is not null").groupBy("table_name", "event_id").agg(F.min(first("kind")).alias("kind_at"), F.min(first("event_time")).alias("time_at"), F.min("created").alias("arrival"))
    return named.union(rows.where("event_id is null").select("table_name", "event_id", first("kind"), first("event_time"), "created"))


def known(seen: DataFrame) -> DataFrame:
    return seen.select("table_name", "event_id", F.col("kind_at.kind").alias("kind"), F.col("time_at.event_time").alias("event_time"), "arrival")


def admitted(events: DataFrame, limits: DataFrame) -> DataFrame:
    """The events that have a time and an arrival, with hour, allowed and too_late."""
    allowed = limits.select(normal.key("event_kind").alias("kind"), F.col("allowed_lateness_ms").cast("long").alias("allowed")).where("kind is not null").groupBy("kind").agg(F.max("allowed").alias("allowed"))
    timed = events.where("event_time is not null and arrival is not null").join(allowed, "kind", "left")
    hour = F.col("event_time") - F.pmod("event_time", F.lit(HOUR_MS))
    limit = F.coalesce("allowed", F.lit(0))
    return timed.withColumn("hour", hour).withColumn("known_kind", F.col("allowed").isNotNull()).withColumn("too_late", F.col("arrival") > F.col("hour") + HOUR_MS + limit)


def late_events(vision: DataFrame, tracks: DataFrame, limits: DataFrame) -> DataFrame:
    """table_name, event_id of the events whose first arrival is beyond the cut-off of their hour."""
    return admitted(arrivals(vision, tracks), limits).where("too_late and known_kind and event_id is not null").select("table_name", "event_id")


def deltas(events: DataFrame, epoch_ms: int = EPOCH_MS) -> DataFrame:
    """table_name, kind, hour_ms, version, sign, n_events, sum_delay_ms from what admitted() returns.

    Version 0 is the hour as it stood at its end; it has no retraction. Each later version comes as the retraction of the
    one before it (sign -1) and the new aggregate (sign +1), both with the new version's number.
    """
    end = F.col("hour") + HOUR_MS
    epoch = F.when(F.col("arrival") <= end, F.lit(0)).otherwise(F.call_function("div", F.col("arrival") - end - 1, F.lit(epoch_ms)) + 1)
    parts = events.where("not too_late").groupBy("table_name", "kind", "hour", epoch.cast("long").alias("epoch")).agg(F.count("*").alias("n"), F.sum(F.greatest(F.lit(0), F.col("arrival") - F.col("event_time"))).alias("delay"))
    so_far = Window.partitionBy("table_name", "kind", "hour").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("table_name", "kind", "hour").orderBy("epoch")
    state = parts.select("*", F.sum("n").over(so_far).alias("n_now"), F.sum("delay").over(so_far).alias("delay_now"), (F.row_number().over(before) - 1).cast("long").alias("version"))
    old = F.struct(F.lit(-1).alias("sign"), (F.col("n_now") - F.col("n")).alias("n_events"), (F.col("delay_now") - F.col("delay")).alias("sum_delay_ms"))
    new = F.struct(F.lit(1).alias("sign"), F.col("n_now").alias("n_events"), F.col("delay_now").alias("sum_delay_ms"))
    both = F.explode(F.when(F.col("version") > 0, F.array(old, new)).otherwise(F.array(new)))
    return state.select("table_name", "kind", F.col("hour").alias("hour_ms"), "version", both.alias("d")).select("table_name", "kind", "hour_ms", "version", "d.*")


def folded(changes: DataFrame, period_ms: int = HOUR_MS) -> DataFrame:
    """table_name, kind, period_ms, n_events, sum_delay_ms: the sum of signed deltas per period, as downstream keeps it."""
    start = (F.col("hour_ms") - F.pmod("hour_ms", F.lit(period_ms))).alias("period_ms")
    signed = lambda c: F.sum(F.col("sign") * F.col(c)).alias(c)
    return changes.groupBy("table_name", "kind", start).agg(signed("n_events"), signed("sum_delay_ms"))


def hourly(vision: DataFrame, tracks: DataFrame, limits: DataFrame) -> DataFrame:
    """table_name, kind, period_ms, n_events, sum_delay_ms, n_too_late per hour, after all admissible corrections."""
    events = admitted(arrivals(vision, tracks), limits)
    final = folded(deltas(events))
    late = events.groupBy("table_name", "kind", F.col("hour").alias("period_ms")).agg(F.count_if("too_late").alias("n_too_late"))
    same = late["table_name"].eqNullSafe(final["table_name"]) & late["kind"].eqNullSafe(final["kind"]) & (late["period_ms"] == final["period_ms"])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return late.join(final, same, "left").select(late["table_name"], late["kind"], late["period_ms"], zero("n_events"), zero("sum_delay_ms"), "n_too_late")


class HourlyState:
    """Hourly aggregates kept in a folder that all executors share, changed batch by batch.

    Holds for each hour its version and aggregate, and what is known of each event. The ledger names the tables that hold
    the state after each batch, and is replaced by one rename, so that a batch either counts as a whole or not at all, and
    one that comes again changes nothing. One writer at a time.
    forget: drops events once the cut-off of their hour lies before the newest arrival, so that the state does not grow
    without end; a copy that comes later still counts as too late, even if the event was counted in time.
    """

    def __init__(self, limits: DataFrame, folder: str, epoch_ms: int = EPOCH_MS, forget: bool = False):
        self.spark, self.limits, self.folder, self.epoch_ms, self.forget = limits.sparkSession, limits, folder.rstrip("/"), epoch_ms, forget
        held = read_text(self.spark, f"{self.folder}/_state.json")
        self.state = json.loads(held) if held else {"batches": [], "events": None, "hours": None}

    def _table(self, name: str, schema: str) -> DataFrame:
        at = self.state[name]
        return self.spark.read.schema(schema).parquet(at) if at else self.spark.createDataFrame([], schema)

    def hours(self) -> DataFrame:
        """table_name, kind, hour, version, n_events, sum_delay_ms of every hour that has an event."""
        return self._table("hours", "table_name string, kind string, hour long, version long, n_events long, sum_delay_ms long")

    def events(self) -> DataFrame:
        return self._table("events", "table_name string, event_id string, kind_at struct<created: bigint, kind: string>, time_at struct<created: bigint, event_time: bigint>, arrival long")

    def _counted(self, seen: DataFrame, sign: int) -> DataFrame:
        """What sightings count: table_name, kind, hour, delay, with a sign; `came` is the arrival of the batch's copy."""
        e = admitted(seen.select("table_name", "event_id", F.col("kind_at.kind").alias("kind"), F.col("time_at.event_time").alias("event_time"), "arrival", "came"), self.limits)
        return e.where("not too_late").select("table_name", "kind", "hour", F.greatest(F.lit(0), F.col("arrival") - F.col("event_time")).alias("delay"), F.lit(sign).cast("long").alias("sign"), "came")

    def apply(self, rows: DataFrame, batch: str) -> DataFrame:
        """The deltas of a batch of copies(): table_name, kind, hour_ms, version, sign, n_events, sum_delay_ms.

        Empty if the batch was applied before.
        """
        if batch in self.state["batches"]:
            return self._deltas(self.spark.createDataFrame([], "table_name string, kind string, hour long, delay long, sign long, came long"))[0]
        held, key = self.events(), ["table_name", "event_id"]
        new = sightings(rows)
        named = new.where("event_id is not null")
        before = held.join(named.select(*key, F.col("arrival").alias("came")), key)
        after = named.withColumn("came", F.col("arrival")).unionByName(before).groupBy(*key).agg(F.min("kind_at").alias("kind_at"), F.min("time_at").alias("time_at"), F.min("arrival").alias("arrival"), F.max("came").alias("came"))
        at = f"{self.folder}/{uuid.uuid4().hex[:12]}"
        after.write.parquet(f"{at}/after")
        after = self.spark.read.schema(after.schema).parquet(f"{at}/after")
        changes = self._counted(before, -1).union(self._counted(after, 1)).union(self._counted(new.where("event_id is null").withColumn("came", F.col("arrival")), 1))
        out, hours = self._deltas(changes)
        out.write.parquet(f"{at}/deltas")
        hours.write.parquet(f"{at}/hours")
        events = held.join(after.select(*key), key, "left_anti").unionByName(after.drop("came"))
        if self.forget:
            timed = admitted(known(events), self.limits).withColumn("end", F.col("hour") + HOUR_MS + F.coalesce("allowed", F.lit(0)))
            newest = F.broadcast(events.agg(F.max("arrival").alias("newest")))  # one row
            gone = timed.crossJoin(newest).where("end < newest").select(*key)
            events = events.join(gone, key, "left_anti")
        events.write.parquet(f"{at}/events")
        was = self.state
        self.state = {"batches": [*was["batches"], batch], "events": f"{at}/events", "hours": f"{at}/hours"}
        write_text(self.spark, f"{self.folder}/_state.json", json.dumps(self.state))
        for old in (was["events"], was["hours"]):
            if old:
                remove(self.spark, old)
        remove(self.spark, f"{at}/after")
        return self.spark.read.schema(out.schema).parquet(f"{at}/deltas")

    def _deltas(self, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What is sent on, and the hours after it. An hour has one version per epoch in which the batch changes it."""
        by = ["table_name", "kind", "hour"]
        end = F.col("hour") + HOUR_MS
        epoch = F.when(F.col("came") <= end, F.lit(0)).otherwise(F.call_function("div", F.col("came") - end - 1, F.lit(self.epoch_ms)) + 1)
        parts = changes.groupBy(*by, epoch.cast("long").alias("epoch")).agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("delay")).alias("delay")).where("n <> 0 or delay <> 0")
        was = self.hours().select(F.col("table_name").alias("_t"), F.col("kind").alias("_k"), F.col("hour").alias("_h"), F.col("version").alias("v"), F.col("n_events").alias("n0"), F.col("sum_delay_ms").alias("d0"))
        joined = parts.join(was, F.col("table_name").eqNullSafe(F.col("_t")) & F.col("kind").eqNullSafe(F.col("_k")) & (F.col("hour") == F.col("_h")), "left")
        order = Window.partitionBy(*by).orderBy("epoch")
        upto = order.rowsBetween(Window.unboundedPreceding, 0)
        zero = lambda c: F.coalesce(c, F.lit(0))
        now = joined.select(*by, "n", "delay", (zero("n0") + F.sum("n").over(upto)).alias("n_now"), (zero("d0") + F.sum("delay").over(upto)).alias("d_now"), (F.coalesce("v", F.lit(-1)) + F.row_number().over(order)).cast("long").alias("version"))
        old = F.struct(F.lit(-1).alias("sign"), (F.col("n_now") - F.col("n")).alias("n_events"), (F.col("d_now") - F.col("delay")).alias("sum_delay_ms"))
        new = F.struct(F.lit(1).alias("sign"), F.col("n_now").alias("n_events"), F.col("d_now").alias("sum_delay_ms"))
        both = F.explode(F.when(F.col("version") > 0, F.array(old, new)).otherwise(F.array(new)))
        out = now.select("table_name", "kind", F.col("hour").alias("hour_ms"), "version", both.alias("d")).select("table_name", "kind", "hour_ms", "version", "d.*")
        last = now.select(*by, "version", F.col("n_now").alias("n_events"), F.col("d_now").alias("sum_delay_ms"))
        hours = self.hours().unionByName(last).groupBy(*by).agg(F.max(F.struct("version", "n_events", "sum_delay_ms")).alias("x")).select(*by, "x.*")
        return out, hours
