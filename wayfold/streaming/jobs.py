"""Streams: the stateful operators, windows by event time, and sinks that may be repeated.

A stream is any streaming DataFrame; tests drive file streams to their end. State is kept per run, track or message, in
the state store that the checkpoint folder holds, so a lost executor costs a replay of one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracks import Aggregator, Challenge, Head, Track, Tracker
from ..session import shared_folder


def checkpoint_folder(df: DataFrame, name: str) -> str:
    return f"{shared_folder(df.sparkSession)}/streams/{name}"


def windowed_counts(events: DataFrame, time: str, late: str, size: str, slide: str | None = None, keys: tuple[str, ...] = (), total: str | None = None) -> DataFrame:
    """Counts (and sums) per aligned window; events later than the watermark are dropped. An extension of the engine."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    sums = [F.sum(total).alias("total")] if total else []
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n"), *sums).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", *(["total"] if total else []))


def sessions(events: DataFrame, time: str, late: str, gap: str, keys: tuple[str, ...]) -> DataFrame:
    """Sessions that end after a gap without events. An extension of the engine."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def once_per_key(messages: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """The first copy of each message within the watermark; later copies are dropped from bounded state."""
    return messages.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def latest_per_key(batch: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Within a batch only the newest row per key stays pending, with the number of rows it replaced."""
    others = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(sequence)).alias("r"), (F.count("*") - 1).alias("replaced")).select(*keys, "r.*", "replaced")


_TRACKER = "last_sequence long, next_id long, rejected long, ids array<long>, boxes array<array<double>>, firsts array<long>, lasts array<long>, hits array<int>, confirmed array<boolean>"


def followed(frames: DataFrame, **settings) -> DataFrame:
    """run_id, frame_sequence, track, state per box, as frames arrive; settings are those of Tracker.

    frames: run_id, frame_sequence, captured_at_ms, boxes array<array<double>>. Exits come as rows of state 'EXITED' at the
    frame that caused them. Frames that come late for their run are rejected, as the tracker does not wait.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t = Tracker(**settings)
        if state.exists:
            last, t.next_id, t.rejected, ids, boxes, firsts, lasts, hits, confirmed = state.get
            t.last_sequence = None if last < 0 else last
            t.active = [Track(i, tuple(b), f, la, h, c) for i, b, f, la, h, c in zip(ids, boxes, firsts, lasts, hits, confirmed, strict=True)]
        rows = []
        for pdf in batches:
            for r in pdf.sort_values("frame_sequence").itertuples():
                found, gone = t.frame(int(r.frame_sequence), int(r.captured_at_ms), [tuple(b) for b in r.boxes])
                sure = {x.id for x in [*t.active, *gone] if x.confirmed}
                rows += [(key[0], r.frame_sequence, i, "CONFIRMED" if i in sure else "TENTATIVE") for i in found or []]
                rows += [(key[0], r.frame_sequence, x.id, "EXITED") for x in gone]
        a = t.active
        state.update((-1 if t.last_sequence is None else t.last_sequence, t.next_id, t.rejected, [x.id for x in a], [list(map(float, x.box)) for x in a], [x.first for x in a], [x.last for x in a], [x.hits for x in a], [x.confirmed for x in a]))
        yield pd.DataFrame(rows, columns=["run_id", "frame_sequence", "track", "state"])

    return frames.groupBy("run_id").applyInPandasWithState(step, "run_id string, frame_sequence long, track long, state string", _TRACKER, "append", GroupStateTimeout.NoTimeout)


_HEADS = "kept array<struct<sequence: long, quality: double, label: string, confidence: double>>, last_sequence long, stale long, label string, confidence double, switches int, challenger string, running int, conflicts int"


def settled(observations: DataFrame, threshold: float, **settings) -> DataFrame:
    """track, sequence, label, stable after each batch of observations (track, sequence, label, confidence, quality)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        a = Aggregator({"label": threshold}, **settings)
        if state.exists:
            kept, a.last_sequence, a.stale, label, confidence, switches, challenger, running, conflicts = state.get
            a.kept = [{"sequence": k[0], "quality": k[1], "label": (k[2], k[3])} for k in kept]
            a.heads["label"] = Head(threshold, label, confidence, switches, Challenge(challenger or None, running, conflicts))
        last = None
        for pdf in batches:
            for r in pdf.sort_values("sequence").itertuples():
                if a.add(int(r.sequence), float(r.quality), label=(r.label, float(r.confidence))):
                    last = int(r.sequence)
        h = a.heads["label"]
        state.update(([(k["sequence"], k["quality"], *k["label"]) for k in a.kept], a.last_sequence, a.stale, h.label, h.confidence, h.switches, h.challenge.label or "", h.challenge.count, h.challenge.conflicts))
        label, _, stable = a.outcome("label")
        yield pd.DataFrame([(key[0], last, label, stable)] if last is not None else [], columns=["track", "sequence", "label", "stable"])

    return observations.groupBy("track").applyInPandasWithState(step, "track long, sequence long, label string, stable boolean", _HEADS, "append", GroupStateTimeout.NoTimeout)


def idempotent_sink(stream: DataFrame, path: str, keys: list[str], checkpoint: str, derive: dict[str, Callable[[DataFrame], DataFrame]] | None = None):
    """Starts a stream whose batches may be written again without effect.

    Each batch replaces its own folder batch_id=n of the main table and of every derived table, so a batch that is replayed
    after a failure leaves the same rows. Rows are unique by key within a batch. The tables of one batch are not one
    transaction: readers that need all of them wait for the next batch to begin.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(keys).persist()
        try:
            rows.write.mode("overwrite").parquet(f"{path}/main/batch_id={number}")
            for name, f in (derive or {}).items():
                f(rows).write.mode("overwrite").parquet(f"{path}/{name}/batch_id={number}")
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_corrections(events: DataFrame, time: str, arrival: str, allowed: str, late: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, hour, version, sign, n: hourly counts as retractions and assertions, as events arrive.

    The first version of an hour is asserted (sign 1). Whenever a later batch brings events that arrived within `allowed`
    of the end of their hour, the version before is retracted (sign -1) and the new one asserted; whatever sums
    sign * n stays right. State is one row per hour and keys, and is dropped when the watermark (`late` behind the newest
    event) has passed the hour's cut-off. time and arrival are timestamps; null times count nowhere. Send copies of a
    message through once_per_key() first.
    """
    limit = pd.Timedelta(allowed)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hour = pd.Timestamp(key[-1])
        end = hour + pd.Timedelta(hours=1) + limit
        came = sum(int((pdf[arrival] <= end).sum()) for pdf in batches)
        version, n = state.get if state.exists else (-1, 0)
        rows = []
        if came:
            rows = [(*key, version + 1, -1, n)] if version >= 0 else []
            rows.append((*key, version + 1, 1, n + came))
            state.update((version + 1, n + came))
        if state.exists:
            cut_off = int(end.timestamp() * 1000)
            if cut_off > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(cut_off)
            else:
                state.remove()
        yield pd.DataFrame(rows, columns=[*keys, "hour", "version", "sign", "n"])

    fields = {f.name: f.dataType.simpleString() for f in events.schema}
    ddl = "".join(f"{k} {fields[k]}, " for k in keys) + "hour timestamp, version long, sign int, n long"
    timed = events.where(F.col(time).isNotNull()).withWatermark(time, late).withColumn("hour", F.date_trunc("hour", F.col(time)))
    return timed.groupBy(*keys, "hour").applyInPandasWithState(step, ddl, "version long, n long", "append", GroupStateTimeout.EventTimeTimeout)
