"""The archive: bodies once, versions whole, jobs that die between writing and publishing."""

from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from rulemark.sources.archive import Archive, Conflict, Version

FETCH = "url string, retrieved_at timestamp, status int, etag string, not_modified boolean, sha256 string, body binary"
DAY = dt.datetime(2024, 1, 1)


def fetch(url, day, body=b"", status=200, same=None, sha=None):
    return (url, DAY + dt.timedelta(days=day), status, None, same, sha, body)


def sha(body):
    return hashlib.sha256(body).hexdigest()


@pytest.fixture
def archive(spark, tmp_path):
    return Archive(spark, str(tmp_path / "archive"))


def put(archive, *rows):
    return archive.put(archive.spark.createDataFrame(list(rows), FETCH))


def test_bodies_once_and_latest(spark, archive):
    assert archive.latest().count() == 0 and archive.version().number == 0
    put(archive, fetch("a", 0, b"one"), fetch("b", 0, b"one"), fetch("a", 0, b"one"), fetch(None, 0, b"x"), fetch("c", 0, None))
    put(archive, fetch("a", 1, b"two"), fetch("a", 0, b"other"), fetch("b", 1, b"gone", status=404), fetch("b", 2, same=True, sha=sha(b"one")))
    assert {r["sha256"] for r in archive.table("bodies").collect()} == {sha(x) for x in (b"one", b"", b"two", b"other", b"gone")}
    assert {(r["url"], bytes(r["body"])) for r in archive.latest().collect()} == {("a", b"two"), ("b", b"one"), ("c", b"")}
    assert archive.table("index").count() == 6 and archive.corrupted().count() == 0


def test_a_job_that_dies_before_publishing_leaves_no_trace(spark, archive, monkeypatch):
    put(archive, fetch("a", 0, b"one"))
    before = archive.version()
    monkeypatch.setattr(Archive, "publish", lambda self, version: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        put(archive, fetch("a", 1, b"two"))
    monkeypatch.undo()
    assert archive.version() == before and [bytes(r["body"]) for r in archive.latest().collect()] == [b"one"]
    assert len(archive.leftovers()) == 2
    put(archive, fetch("a", 1, b"two"))
    again = put(archive, fetch("a", 1, b"two"))
    assert again == 3 and archive.table("index").count() == 2 and archive.table("bodies").count() == 2


def test_only_one_writer_has_a_number(spark, archive):
    put(archive, fetch("a", 0, b"one"))
    with pytest.raises(Conflict):
        archive.publish(Version(1))
    with pytest.raises(ValueError, match="no body"):
        put(archive, fetch("a", 1, same=True, sha=sha(b"unknown")))
    assert archive.version().number == 1


def test_migrations_run_once_and_whole(spark, archive, monkeypatch):
    put(archive, fetch("a", 0, b"one"), fetch("b", 0, b"two"))
    runs = []

    def host(df):
        runs.append(1)
        return df.withColumn("host", F.upper("url"))

    steps = [("add host", "index", host), ("drop empty", "bodies", lambda df: df.where("size > 0"))]
    with monkeypatch.context() as m:
        m.setattr(Archive, "publish", lambda self, version: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            archive.migrate(steps)
    assert "host" not in archive.table("index").columns
    assert archive.migrate(steps) == 2 == archive.migrate(steps) and len(runs) == 2
    assert {r["host"] for r in archive.table("index").collect()} == {"A", "B"} and archive.version().migrations == ["add host", "drop empty"]
