"""Queries on events, by the functions that also run on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemark.plans.registry import query
from rulemark.sources.tables import read
from rulemark.streaming import events, intake


@query("session_activity", """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w > INTERVAL 60 MINUTE THEN 1 ELSE 0 END AS cut FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start, CAST(epoch_us(max(ts)) AS BIGINT) AS last, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, s""")
def session_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's sessions: runs of events no more than an hour apart."""
    s = events.sessions(read(spark, sf_dir, "events"), ["user_id"], "60 minutes")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return s.select("user_id", us("start"), us("last"), "n", F.round("total", 6).alias("total"))


@query("hourly_activity", """SELECT CAST(epoch_us(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def hourly_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of every hour and kind."""
    a = intake.activity(read(spark, sf_dir, "events"))
    return a.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "event_type", "n", F.round("total", 6).alias("total"))
