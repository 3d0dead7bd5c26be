"""Streams with late and repeated rows, against what the rows say."""

from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from rulemark.streaming import events, intake

SCHEMA = "key string, ts timestamp, value double, id long"


@pytest.fixture
def source(spark, tmp_path):
    """Files that are read one a batch, in order."""
    folder = tmp_path / "in"
    folder.mkdir()

    def write(name, *batches):
        (folder / name).mkdir()
        for k, rows in enumerate(batches):
            path = folder / name / f"{k}.json"
            path.write_text("\n".join(json.dumps(dict(zip(("key", "ts", "value", "id"), r, strict=True))) for r in rows))
            os.utime(path, (time.time() - 1000 + k, time.time() - 1000 + k))
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder / name))

    return write


def at(minutes):
    return f"2024-01-01T{minutes // 60:02d}:{minutes % 60:02d}:00"


def run(spark, tmp_path, df, name):
    df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-mark")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_repeated_rows_pass_once(spark, source, tmp_path):
    df = source("once", [("a", at(0), 1.0, 1), ("a", at(1), 1.0, 1), ("b", None, 1.0, 9)], [("a", at(5), 1.0, 1), ("a", at(6), 1.0, 2)], [("a", at(300), 1.0, 3)], [("a", at(302), 1.0, 7)], [("a", at(20), 1.0, 4), ("a", at(301), 1.0, 3)])
    got = run(spark, tmp_path, events.once(df, ["id"], late="1 hour"), "once")
    assert sorted(r["id"] for r in got) == [1, 2, 3, 7]  # 4 came later than the watermark allows
    static = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "key string, id int").withColumn("ts", F.current_timestamp())
    assert events.once(static, ["id"]).count() == 2


def test_sessions_close_behind_the_watermark(spark, source, tmp_path):
    df = source("sessions", [("a", at(0), 1.0, 1), ("a", at(20), 2.0, 2), ("b", at(5), 4.0, 3)], [("a", at(45), 8.0, 4), ("a", at(200), 16.0, 5)], [("z", at(600), 0.0, 7)], [("a", at(10), 32.0, 6), ("z", at(601), 0.0, 8)])
    got = {(r["key"], r["start"].minute, r["n"], r["total"]) for r in run(spark, tmp_path, events.sessions(df, ["key"], "30 minutes", late="30 minutes"), "sessions")}
    # The row of minute 10 came after its session had closed.
    assert got == {("a", 0, 3, 11.0), ("b", 5, 1, 4.0), ("a", 20, 1, 16.0)}


def test_tumbling_counts(spark, source, tmp_path):
    df = source("hours", [("a", at(0), 1.0, 1), ("a", at(59), 2.0, 2)], [("a", at(60), 4.0, 3), ("a", at(50), 8.0, 4)], [("a", at(400), 0.0, 5)], [("a", at(401), 0.0, 6)])
    got = {(r["start"].hour, r["n"], r["total"]) for r in run(spark, tmp_path, intake.activity(df, group="key", late="20 minutes"), "hours")}
    assert got == {(0, 3, 11.0), (1, 1, 4.0)}


def test_as_of_waits_for_rows_that_may_still_come(spark, source, tmp_path):
    left = source("trades", [("a", at(10), 0.0, 1), ("b", at(10), 0.0, 2)], [("a", at(30), 0.0, 3)], [("a", at(300), 0.0, 4)], [("a", at(600), 0.0, 5)], [("a", at(601), 0.0, 6)])
    right = source("quotes", [("a", at(12), 12.0, 1)], [("a", at(9), 9.0, 2), ("a", at(10), 10.0, 3)], [("b", at(400), 4.0, 4)], [("a", at(20), 20.0, 5)], [("a", at(700), 7.0, 6)])
    got = {(r["key"], r["ts"].hour * 60 + r["ts"].minute): r["value"] for r in run(spark, tmp_path, events.as_of(left, right, "key", "ts", "value", 3600, late="1 hour"), "asof")}
    assert got[("a", 10)] == 10.0 and got[("b", 10)] is None and got[("a", 30)] == 12.0 and got[("a", 300)] is None
