"""Readers and sinks for the file formats of label sets. Manifest cells are strings; nothing is inferred."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.relational import sums_before
from ..session import read_text, remove, write_text


def csv_manifest(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV with a header, every cell a string, missing cells as ''; a byte order mark is dropped from the first name.

    Raises ValueError if there is no header, or if a wanted column is missing.
    """
    df = spark.read.csv(path, header=True, escape='"', multiLine=False, nullValue="", emptyValue="")
    names = [c.lstrip("﻿") for c in df.columns]
    if not names:
        raise ValueError(f"no header in {path}")
    df = df.toDF(*names)
    missing = [c for c in columns or [] if c not in names]
    if missing:
        raise ValueError(f"no columns {missing} in {path}")
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns or names])


def json_lines(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """One object per line, the last line per key; blank lines are skipped.

    The order of lines is that of file names, then of positions within a file.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    at = lines.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    parsed = at.select(F.from_json("value", schema).alias("r"), F.struct("f", "b", "i").alias("at")).where(F.col(f"r.{key}").isNotNull())
    return parsed.groupBy(F.col(f"r.{key}").alias("_k")).agg(F.max_by("r", "at").alias("r")).select("r.*")


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A document per file; it has to be an object."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def box_lines(spark: SparkSession, path: str) -> DataFrame:
    """image (the file's name), line_number within the file's block order, class_id, cx, cy, w, h, valid.

    A valid line has five fields: a class number and four numbers from 0 to 1, sizes above 0.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("image"), F.posexplode(F.split("value", "\r?\n")).alias("line_number", "line")).where(F.trim("line") != "")
    t = F.split(F.trim("line"), r"\s+")
    num = lambda i: F.get(t, i).try_cast("double")
    out = lines.select("image", "line_number", F.size(t).alias("n"), F.get(t, 0).try_cast("int").alias("class_id"), *[num(i).alias(c) for i, c in enumerate(("cx", "cy", "w", "h"), 1)])
    unit = lambda c: F.coalesce(F.col(c).between(0.0, 1.0), F.lit(False))
    return out.withColumn("valid", (F.col("n") == 5) & F.coalesce(F.col("class_id") >= 0, F.lit(False)) & unit("cx") & unit("cy") & unit("w") & unit("h") & F.coalesce((F.col("w") > 0) & (F.col("h") > 0), F.lit(False))).drop("n")


COCO = (
    "images array<struct<id: long, file_name: string, width: int, height: int>>, categories array<struct<id: int, name: string>>, "
    "annotations array<struct<id: long, image_id: long, category_id: int, bbox: array<double>>>"
)


def coco(spark: SparkSession, path: str) -> DataFrame:
    """file_name, category, x, y, w, h: a row per annotation of every document in the folder."""
    docs = spark.read.schema(COCO).option("multiLine", True).json(path).withColumn("doc", F.col("_metadata.file_path"))
    images = docs.select("doc", F.explode("images").alias("i")).select("doc", F.col("i.id").alias("image_id"), "i.file_name")
    names = docs.select("doc", F.explode("categories").alias("c")).select("doc", F.col("c.id").alias("category_id"), F.col("c.name").alias("category"))
    boxes = docs.select("doc", F.explode("annotations").alias("a")).select("doc", "a.image_id", "a.category_id", "a.bbox")
    j = boxes.join(images, ["doc", "image_id"]).join(names, ["doc", "category_id"])
    return j.select("file_name", "category", *[F.get("bbox", i).alias(c) for i, c in enumerate(("x", "y", "w", "h"))])


TRACK_XML = (
    "_name string, sequence_attribute struct<_sence_weather: string, _weather: string>, frame array<struct<_num: int, target_list: struct<target: array<struct<_id: int, box: struct<_left: double, _top: double, _width: double, _height: double>, "
    "attribute: struct<_vehicle_type: string, _truncation_ratio: double>>>>>>"
)


def track_xml(spark: SparkSession, path: str, row_tag: str = "sequence") -> DataFrame:
    """sequence, weather, frame, target, left, top, width, height, vehicle_type from XML of sequences of frames of targets.

    The weather is also found under its misspelled attribute.
    """
    docs = spark.read.format("xml").option("rowTag", row_tag).schema(TRACK_XML).load(path)
    weather = F.coalesce("sequence_attribute._weather", "sequence_attribute._sence_weather")
    f = docs.select(F.col("_name").alias("sequence"), weather.alias("weather"), F.explode("frame").alias("f")).select("sequence", "weather", F.col("f._num").alias("frame"), F.explode("f.target_list.target").alias("t"))
    return f.select("sequence", "weather", "frame", F.col("t._id").alias("target"), *[F.col(f"t.box._{c}").alias(c) for c in ("left", "top", "width", "height")], F.col("t.attribute._vehicle_type").alias("vehicle_type"))


def archive_members(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".csv",), largest: int = 64 << 20) -> DataFrame:
    """archive, member, content of the zip and tar files in a folder; see members_of()."""
    return members_of(spark.read.format("binaryFile").load(path).select("path", "content"), suffixes, largest)


def members_of(archives: DataFrame, suffixes: tuple[str, ...] = (".csv",), largest: int = 64 << 20, leave_out_larger: bool = False) -> DataFrame:
    """archive, member, content of archives (path, content), for allowed members only.

    Allowed are regular files with one of the suffixes, of at most `largest` bytes, whose path is relative and has no
    '..'. An archive is read by one task, as its format demands. Raises ValueError for a member that is larger, unless
    leave_out_larger is set.
    """

    def members(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
        def good(n: str, size: int) -> bool:
            if not allowed(n):
                return False
            if size > largest and not leave_out_larger:
                raise ValueError(f"{name}: {n} has {size} bytes, of which {largest} are allowed")
            return size <= largest

        allowed = lambda n: n.lower().endswith(suffixes) and not n.startswith(("/", "\\")) and ".." not in n.replace("\\", "/").split("/")
        if zipfile.is_zipfile(io.BytesIO(data)):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for m in z.infolist():
                    if not m.is_dir() and good(m.filename, m.file_size):
                        yield m.filename, z.read(m)
        else:
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                for m in t:
                    if m.isfile() and good(m.name, m.size):
                        yield m.name, t.extractfile(m).read()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(p, n, c) for p, data in zip(pdf["path"], pdf["content"], strict=True) for n, c in members(p, data)]
            yield pd.DataFrame(rows, columns=["archive", "member", "content"])

    return archives.select("path", "content").mapInPandas(run, "archive string, member string, content binary")


# ---- sinks


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The given columns in the given order; others are dropped. Refuses to overwrite."""
    df.select(*columns).write.mode("errorifexists").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_once(df: DataFrame, path: str) -> None:
    """Parquet that is never overwritten: an existing path is an error."""
    df.write.mode("errorifexists").parquet(path)


def publish(df: DataFrame, path: str) -> None:
    """All or nothing: written beside the target first, then renamed into its place, which must be free."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    final, staged = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".staged")
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(final):
        raise FileExistsError(path)
    df.write.mode("overwrite").parquet(staged.toString())
    if not fs.rename(staged, final):
        remove(spark, staged.toString())
        raise OSError(f"could not publish {path}")


def report_json(df: DataFrame) -> str:
    """A report of one row as JSON: indented by 2, in UTF-8, with a final line end. For rows of counters and gates."""
    row = df.first()
    return json.dumps(row.asDict(recursive=True) if row else {}, ensure_ascii=False, indent=2) + "\n"


def metric_lines(metrics: DataFrame, name: str = "name", value: str = "value", labels: dict[str, str] | None = None) -> DataFrame:
    """A text line per metric: name{label="value",...} value. labels: from label names to columns; null labels are left out."""
    quote = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"')
    parts: list[Column] = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'{k}="'), quote(F.col(c).cast("string")), F.lit('"'))) for k, c in (labels or {}).items()]
    body = F.array_join(F.array_compact(F.array(*parts)), ",") if parts else F.lit("")
    return metrics.select(F.concat(F.col(name), F.when(body != "", F.concat(F.lit("{"), body, F.lit("}"))).otherwise(""), F.lit(" "), F.col(value).cast("string")).alias("line"))


def produce(messages: DataFrame, stream: str) -> None:
    """Appends messages to a stream folder, from which a file stream or a batch reads them."""
    messages.write.mode("append").parquet(stream)


def acknowledge(keys: DataFrame, acknowledged: str) -> None:
    """Notes that messages have been dealt with. Noting one again changes nothing."""
    keys.distinct().write.mode("append").parquet(acknowledged)


def pending(spark: SparkSession, stream: str, acknowledged: str, key: str) -> DataFrame:
    """The messages of a stream that nobody has acknowledged."""
    return spark.read.parquet(stream).join(spark.read.parquet(acknowledged), key, "left_anti")


def commit_batch(tables: dict[str, DataFrame], store: str, batch: str) -> bool:
    """Writes the rows of a batch to several tables, which readers of committed() see together or not at all.

    Each table gets a folder of its own for the batch; then one file names the batch as committed, by a rename. If any
    write fails nothing is named and what was written counts for nothing; a batch that is committed is not written again.
    """
    spark = next(iter(tables.values())).sparkSession
    mark = f"{store}/_committed/{batch}"
    if read_text(spark, mark) is not None:
        return False
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{store}/{name}/batch={batch}")
    write_text(spark, mark, ",".join(sorted(tables)))
    return True


def committed(spark: SparkSession, store: str, name: str, schema) -> DataFrame:
    """The rows of a table from the batches that are committed."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{store}/_committed")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    batches = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
    held = [f"{store}/{name}/batch={b}" for b in batches if name in (read_text(spark, f"{store}/_committed/{b}") or "").split(",")]
    return spark.read.schema(schema).parquet(*held) if held else spark.createDataFrame([], schema)


def latest_after(frames: DataFrame, cursors: DataFrame, key: str, sequence: str) -> DataFrame:
    """Per reader of a key the newest row after its cursor, with the gap: rows that came between and are not seen."""
    after = frames.join(cursors, key).where(F.col(sequence) > F.col("cursor"))
    others = [c for c in frames.columns if c not in (key, sequence)]
    newest = after.groupBy(key, "cursor").agg(F.max(F.struct(sequence, *others)).alias("_r"))
    return newest.select(key, "cursor", "_r.*").withColumn("gap", F.col(sequence) - F.col("cursor") - 1)


def group_reads(messages: DataFrame, workers: DataFrame, now: Column, idle_ms: int) -> DataFrame:
    """message_id, worker, how ('new' or 'reclaimed'). messages: message_id, t, delivered (null if nobody has it); workers: worker.

    Only as many new messages are read as there are workers, so their rank is a limit; idle ones go round the workers in
    order of a bucket of time first, so that no task ranks all of them.
    """
    ranked = workers.select("worker", F.row_number().over(Window.orderBy("worker")).alias("k"))  # a few workers
    n = ranked.count()
    fresh = messages.where("delivered is null").orderBy("t", "message_id").limit(max(1, n)).select("message_id", F.row_number().over(Window.orderBy("t", "message_id")).alias("k"))
    idle = messages.where(F.col("delivered").isNotNull() & (now - F.col("delivered") >= idle_ms)).withColumn("all", F.lit(1))
    turn = sums_before(idle, ["all"], "delivered", [F.col("delivered"), F.col("message_id")], F.lit(1)).select("message_id", (F.col("_before") % max(1, n) + 1).cast("int").alias("k"))
    of = lambda df, how: df.join(F.broadcast(ranked), "k").select("message_id", "worker", F.lit(how).alias("how"))
    return of(fresh, "new").union(of(turn, "reclaimed"))
