import json
import os
import random

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayfold.operators.tracks import Aggregator, Tracker
from wayfold.streaming import jobs


def drive(spark, df, mode="append"):
    name = f"out_{random.randrange(10**9)}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def source(spark, tmp_path, batches, schema):
    names = [f.name for f in StructType.fromDDL(schema).fields]
    (tmp_path / "in").mkdir()
    for i, b in enumerate(batches):
        (tmp_path / "in" / f"{i}.json").write_text("".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in b))
        os.utime(tmp_path / "in" / f"{i}.json", (1000 + i, 1000 + i))  # files are taken in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def test_windows_drop_what_is_too_late(spark, tmp_path):
    s = source(spark, tmp_path, [[("2024-01-01T00:00:10Z",), ("2024-01-01T00:20:00Z",)], [("2024-01-01T00:40:00Z",)], [("2024-01-01T00:00:20Z",)], [("2024-01-01T01:30:00Z",)], [("2024-01-01T03:30:00Z",)]], "ts timestamp")
    out = drive(spark, jobs.windowed_counts(s, "ts", "5 minutes", "10 minutes"))
    got = {str(r["start"]): r["n"] for r in out.collect()}
    assert got["2024-01-01 00:00:00"] == 1 and got["2024-01-01 00:20:00"] == 1


def test_once_per_key(spark, tmp_path):
    s = source(spark, tmp_path, [[("a", "2024-01-01T00:00:10Z"), ("b", "2024-01-01T00:00:11Z")], [("a", "2024-01-01T00:00:12Z")]], "k string, ts timestamp")
    assert sorted(r["k"] for r in drive(spark, jobs.once_per_key(s, "k", "ts", "1 hour")).collect()) == ["a", "b"]


def test_tracking_stream_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    frames = [("r", i, i * 100, [[x := rng.random() / 4, 0.1, x + 0.4, 0.6]] if i % 5 else []) for i in range(1, 25)]
    schema = "run_id string, frame_sequence long, captured_at_ms long, boxes array<array<double>>"
    out = drive(spark, jobs.followed(source(spark, tmp_path, [frames[:9], frames[9:16], frames[16:]], schema), timeout=150))
    t, want = Tracker(timeout=150), []
    for _, s, at, boxes in frames:
        ids, gone = t.frame(s, at, [tuple(b) for b in boxes])
        want += [(s, i) for i in ids] + [(s, x.id) for x in gone]
    assert sorted((r["frame_sequence"], r["track"]) for r in out.collect()) == sorted(want)


def test_settling_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    obs = [(1, i, rng.choice(["a", "a", "b", "unknown"]), 0.9, rng.random()) for i in range(1, 31)]
    out = drive(spark, jobs.settled(source(spark, tmp_path, [obs[:10], obs[10:20], obs[20:]], "track long, sequence long, label string, confidence double, quality double"), 0.3))
    a, want = Aggregator({"label": 0.3}), []
    for i, (_, s, label, c, q) in enumerate(obs):
        a.add(s, q, label=(label, c))
        if i % 10 == 9:
            want.append((s, *a.outcome("label")[::2]))
    assert sorted((r["sequence"], r["label"], r["stable"]) for r in out.collect()) == want


def test_sink_can_be_repeated(spark, tmp_path):
    s = source(spark, tmp_path, [[("a", 1), ("a", 1), ("b", 2)]], "k string, v int")
    for _ in range(2):  # the second run has a new checkpoint, so it writes the same batch again
        q = jobs.idempotent_sink(s, str(tmp_path / "out"), ["k"], str(tmp_path / f"c{_}"), {"big": lambda d: d.where("v > 1")})
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/main")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out/big")).select(F.max("v")).first()[0] == 2


def test_latest_per_key(spark):
    d = spark.createDataFrame([("r", 1, "x"), ("r", 3, "y"), ("q", 2, "z")], "run string, s int, v string")
    assert sorted(tuple(r) for r in jobs.latest_per_key(d, ["run"], "s").collect()) == [("q", 2, "z", 0), ("r", 3, "y", 1)]


def test_hourly_corrections_retract_what_they_asserted(spark, tmp_path):
    """Late events within the cut-off correct an hour by a retraction and an assertion; later ones change nothing."""
    at = lambda text: f"2026-03-01T{text}:00Z"
    batches = [
        [(at("10:05"), at("10:06"), "a"), (at("10:50"), at("10:51"), "a"), (at("10:10"), at("10:11"), "b")],
        [(at("10:20"), at("11:10"), "a"), (at("11:01"), at("11:02"), "a"), (None, at("11:02"), "a")],
        [(at("10:30"), at("11:20"), "a"), (at("11:30"), at("11:31"), "b")],
    ]
    out = drive(spark, jobs.hourly_corrections(source(spark, tmp_path, batches, "t timestamp, arrived timestamp, kind string"), "t", "arrived", "15 minutes", "2 hours", ("kind",)))
    got = sorted((r["kind"], r["hour"].hour, r["version"], r["sign"], r["n"]) for r in out.collect())
    assert got == [("a", 10, 0, 1, 2), ("a", 10, 1, -1, 2), ("a", 10, 1, 1, 3), ("a", 11, 0, 1, 1), ("b", 10, 0, 1, 1), ("b", 11, 0, 1, 1)]
