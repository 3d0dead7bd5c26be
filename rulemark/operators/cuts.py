"""Cutting the lineage of frames that rounds build on, and spreading rows over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder that spark.checkpoint.dir names; on one machine, where none is set, beside the warehouse."""
    session = df.sparkSession
    context = session.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = session.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = session.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
        context.setCheckpointDir(folder)
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys over all shuffle partitions, which adaptive execution leaves apart however well their bytes compress."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys)
