"""Session settings and the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}
_scratch: list[tuple[SparkSession, str]] = []


def _clear_scratch() -> None:
    """Removes the scratch tables when Python ends; results are lazy, so they are needed until then."""
    for spark, root in _scratch:
        try:
            remove(spark, root)
        except Exception:  # noqa: BLE001  the session may have ended already
            return


atexit.register(_clear_scratch)


def local_session(app: str = "wayfold", cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for one machine: UTC, adaptive execution, few shuffle partitions."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local session without it gets a temporary one.

    Raises ValueError on a cluster without the setting, since a folder of one machine would lose data there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = tempfile.mkdtemp(prefix="wayfold-")
        atexit.register(shutil.rmtree, _made[app], True)
    return _made[app]


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive the loss of executors."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/wayfold-{purpose}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        _scratch.append((spark, self.root))

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        """Writes df and reads it again, with its schema given so that no footer has to be read first."""
        at = self.path(name)
        (df.write.partitionBy(*by) if by else df.write).parquet(at)
        back = self.spark.read.schema(df.schema).parquet(at)
        back._wayfold_path = at
        return back

    def drop(self, df: DataFrame) -> None:
        """Removes a table that keep() wrote, once nothing refers to it any more."""
        at = getattr(df, "_wayfold_path", None)
        if at:
            remove(self.spark, at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file on whatever file system holds it; None if there is none."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside its place and renames it, so that readers see the old text or the new one."""
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI(path) if "://" in path or path.startswith("file:") else jvm.java.io.File(path).toURI(), spark.sparkContext._jsc.hadoopConfiguration())
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:8]}")
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, where, options)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
