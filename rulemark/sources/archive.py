"""An archive of fetched documents: bodies kept once by content, an index of fetches, published in versions.

``bodies`` holds each distinct body under its SHA-256, ``index`` a row a fetch. A
put writes new folders of both, then publishes a version: a small manifest that
lists all folders that count. The manifest is written aside and renamed to the
next number, which only one writer can have; readers take the highest number.
So a job that dies before it has published leaves the archive as it was, one
that is run again after it has published finds its fetches there, and nobody
ever sees half a version. Paths go through Hadoop's file systems.

Migrations are numbered functions from one version's tables to the next ones';
those that a version has had are listed in its manifest and not run again.

Defined results: a fetch is told by url and time of retrieval, and stored once;
a null body is stored as an empty one; a fetch that was not modified names the
digest of a body that must be known, and holds none; nulls in url or time raise
nothing and make no fetch; an archive without a version is empty.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BODIES = "sha256 string, size long, body binary"
INDEX = "url string, retrieved_at timestamp, status int, sha256 string, etag string, not_modified boolean"


class Conflict(RuntimeError):
    """Another writer has published the version that this one was to be; nothing is lost: put again."""


@dataclass(frozen=True)
class Version:
    """What counts: folders by table, their schemas, and the migrations that these tables have had."""

    number: int = 0
    folders: dict[str, list[str]] = field(default_factory=lambda: {"bodies": [], "index": []})
    schemas: dict[str, str] = field(default_factory=lambda: {"bodies": BODIES, "index": INDEX})
    migrations: list[str] = field(default_factory=list)


class Archive:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> Version:
        """The version that readers see."""
        fs, folder = self._files(), self._path("versions")
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
        published = [n for n in names if n.startswith("v")]
        if not published:
            return Version()
        lines = self.spark.read.text(f"{self.root}/versions/{published[-1]}", wholetext=True).first()[0]
        return Version(**json.loads(lines))

    def table(self, name: str, version: Version | None = None) -> DataFrame:
        v = version or self.version()
        if not v.folders[name]:
            return self.spark.createDataFrame([], v.schemas[name])
        return self.spark.read.schema(v.schemas[name]).parquet(*(f"{self.root}/{f}" for f in v.folders[name]))

    def stage(self, name: str, rows: DataFrame) -> str:
        """Writes rows to a folder that counts only once a version lists it."""
        folder = f"{name}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        return folder

    def publish(self, version: Version) -> None:
        """Makes a version the one to be seen, if it follows the present one."""
        fs, aside, name = self._files(), self._path(f"aside/{uuid.uuid4().hex}"), self._path(f"versions/v{version.number:09d}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(version.__dict__).encode()))
        out.close()
        fs.mkdirs(self._path("versions"))
        # A rename onto a name that is taken fails: the number belongs to the first writer.
        if fs.exists(name) or not fs.rename(aside, name):
            fs.delete(aside, False)
            raise Conflict(f"version {version.number} is published already")

    def put(self, fetches: DataFrame) -> int:
        """Stores fetches (url, retrieved_at, status, etag, not_modified, sha256, body) that are not stored yet; gives the version's number.

        ``sha256`` counts where a fetch was not modified. Bodies known to the archive, or repeated among the fetches, are not written again.
        """
        now = self.version()
        old, known = self.table("index", now).select("url", "retrieved_at"), self.table("bodies", now).select("sha256")
        body = F.coalesce("body", F.lit(b""))
        same = F.coalesce("not_modified", F.lit(False))
        digest = F.when(same, F.col("sha256")).otherwise(F.sha2(body, 256))
        rows = fetches.where("url IS NOT NULL AND retrieved_at IS NOT NULL").select("url", "retrieved_at", "status", digest.alias("sha256"), "etag", same.alias("not_modified"), body.alias("body"))
        index = self.stage("index", rows.drop("body").dropDuplicates(["url", "retrieved_at"]).join(old, ["url", "retrieved_at"], "left_anti").select(*(c.split()[0] for c in INDEX.split(", "))))
        # Digests first: bodies travel only where they are new, one of each.
        new = rows.where("NOT not_modified").join(known, "sha256", "left_anti").groupBy("sha256").agg(F.first("body").alias("body"))
        bodies = self.stage("bodies", new.select("sha256", F.octet_length("body").cast("long").alias("size"), "body"))
        after = Version(now.number + 1, {"bodies": [*now.folders["bodies"], bodies], "index": [*now.folders["index"], index]}, now.schemas, now.migrations)
        lost = self.table("index", Version(0, {"bodies": [], "index": [index]}, now.schemas)).where("not_modified").join(self.table("bodies", after).select("sha256"), "sha256", "left_anti")
        if one := lost.first():
            raise ValueError(f"{one['url']} was not modified, but no body {one['sha256']} is known")
        self.publish(after)
        return after.number

    def latest(self) -> DataFrame:
        """The newest fetch of every url that brought a body, with it."""
        newest = Window.partitionBy("url").orderBy(F.col("retrieved_at").desc(), "sha256")
        found = self.table("index").where("NOT not_modified AND status BETWEEN 200 AND 299").withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
        return found.join(self.table("bodies"), "sha256")

    def corrupted(self) -> DataFrame:
        """(sha256): bodies whose bytes no longer give their digest."""
        return self.table("bodies").where(F.sha2("body", 256) != F.col("sha256")).select("sha256")

    def migrate(self, steps: Sequence[tuple[str, str, Callable[[DataFrame], DataFrame]]]) -> int:
        """Runs the named (name, table, function) steps that the archive has not had, all in one new version; gives its number."""
        now = self.version()
        folders, schemas, had = {k: list(v) for k, v in now.folders.items()}, dict(now.schemas), list(now.migrations)
        for name, table, change in steps:
            if name in had:
                continue
            at = Version(0, folders, schemas)
            rows = change(self.table(table, at))
            folders[table] = [self.stage(table, rows)]
            schemas[table] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
            had.append(name)
        if had == now.migrations:
            return now.number
        self.publish(Version(now.number + 1, folders, schemas, had))
        return now.number + 1

    def leftovers(self) -> list[str]:
        """Folders that no version lists: of jobs that died, or still at work."""
        fs, listed = self._files(), set()
        folder = self._path("versions")
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            v = json.loads(self.spark.read.text(status.getPath().toString(), wholetext=True).first()[0])
            listed |= {f for names in v["folders"].values() for f in names}
        there = [f"{t}/{s.getPath().getName()}" for t in ("bodies", "index") if fs.exists(self._path(t)) for s in fs.listStatus(self._path(t))]
        return sorted(f for f in there if f not in listed)
