"""Session settings that the engine expects: UTC, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; ``conf`` adds or overrides keys (dots as __)."""
    builder = SparkSession.builder.appName("rulemark").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
