"""Small helpers shared by the operators."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch handed to Python: bound a worker's memory, as texts may be long.
ARROW_ROWS = 1 << 14
ARROW_BYTES = 4 << 20


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that df does not have (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of Arrow batches to ARROW_ROWS and ARROW_BYTES where they are larger."""
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).rstrip("bB")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def _folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; gone when the driver's JVM ends."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        held = context._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
    folder = f"{root.rstrip('/')}/rulemark-{context.applicationId}"
    if folder not in _KNOWN:
        _KNOWN.add(folder)
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


_KNOWN: set[str] = set()


def buckets(spark: SparkSession) -> int:
    """Buckets of a table that ``Store.put`` writes by a column: the session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Store:
    """Intermediate tables of one job, as zstd Parquet below the folder that spark.checkpoint.dir names.

    A table cuts the lineage as a checkpoint does, survives lost executors, is read
    by columns, and goes as soon as ``drop`` is told, not when garbage is collected.
    Where spark.checkpoint.dir is unset (tests on one machine), a folder beside the
    warehouse takes its place.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str, str | None]] = {}

    def put(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """df, written and read again; with ``by`` in one bucket a shuffle partition, so that joins on it move no row of it."""
        name = f"rulemark_{uuid.uuid4().hex}"
        path = f"{_folder(self.spark)}/{name}"
        writer = df.write.option("compression", "zstd")
        if by:
            # df must be dealt by this column already: a task writes one bucket, so rows need no sort by bucket.
            key = "spark.sql.maxConcurrentOutputFileWriters"
            before = self.spark.conf.get(key)
            self.spark.conf.set(key, "8")
            try:
                writer.bucketBy(buckets(self.spark), by).option("path", path).format("parquet").saveAsTable(name)
            finally:
                self.spark.conf.set(key, before)
            out = self.spark.table(name)
        else:
            writer.parquet(path)
            out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path, name if by else None)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes the tables behind frames that ``put`` returned; nothing may read them any more."""
        context = self.spark.sparkContext
        for frame in frames:
            _, path, table = self.paths.pop(id(frame))
            if table:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, as a table that stays until the application ends."""
    return Store(df.sparkSession).put(df)


def crc_mod(column: str, n: int):
    """crc32 of the column's text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def sweep(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files of frames that are no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
