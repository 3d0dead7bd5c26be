"""Incremental intake of filings: a file stream that stores what is new, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rulemark.operators.store import unseen


def intake(spark: SparkSession, incoming: str, stored: str, checkpoint: str, schema: str, keys: list[str]) -> StreamingQuery:
    """Starts a run over all JSON files of ``incoming`` that no run has read; rows of stored keys are skipped.

    The checkpoint folder remembers the files read, and the batch's anti join the
    keys stored, so a run repeated after a failure appends nothing twice.
    """
    rows = spark.readStream.schema(schema).json(incoming)

    def put(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        try:
            known = session.read.schema(batch.schema).parquet(stored)
        except Exception as missing:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            known = batch.limit(0)
        unseen(batch, known, keys).write.mode("append").parquet(stored)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, time: str = "ts", group: str = "event_type", value: str = "value", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling window and group; rows later than ``late`` are left out of a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), group).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), group, "n", "total")
