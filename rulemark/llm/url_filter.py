"""URL filtering: explicit rules first, then exact list membership by a Bloom filter cascade.

A list holds keys: hosts (a host stands for all its subdomains) and single pages
(host and path). The keys that urls may ask for are known in full: the corpus's
own hosts, their parent domains and pages. So a filter's false positives can be
found and encoded in turn: level 1 holds the listed keys, level 2 the unlisted
ones that level 1 lets through, level 3 the listed ones that level 2 lets
through, and so on until a level lets nothing wrong through. The first level
that lacks a key tells whether it is listed, without error and without joining
urls with the list.

Every level is built by Spark: tasks turn keys into (block, bits) pairs of a
blocked filter, an aggregation ORs them. Only finished levels reach the driver,
to be broadcast. Their size is known from two counts before anything is built;
where it exceeds ``max_bytes``, keys are dealt into shards by hash and each
shard's cascade is built and asked in a pass of its own, rows being written in
between: memory stays bounded, whatever the list, and results are the same.

Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule and no key, and is allowed; an empty list or table blocks nothing;
repeated rows get equal verdicts; a null in the list is no key. Hosts of over
253 characters (no such name can exist) are asked whole and by their suffixes of
up to 253. Columns of the input named like results keep their names, the results
get underscores in front. Two keys with equal 128-bit hashes, one listed and one
not, would keep the cascade from ending: that raises an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulemark.llm.frames import Store, fresh
from rulemark.llm.textbatch import mix

#: Longest host name that exists.
LONGEST_HOST = 253
#: Bits and words of a block; a key's bits all lie in one block.
BLOCK_BITS, BLOCK_WORDS = 512, 8
#: A level above the first lets through one in 2 ** LATER_BITS wrong keys.
LATER_BITS = 3
MAX_KEY_BITS = 14
MAX_BYTES = 64 << 20
MAX_LEVELS = 80


@dataclass(frozen=True)
class Rule:
    """``verdict`` for urls of ``host`` and its subdomains whose path begins with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for null and where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def url_keys(host: Column, path: Column) -> Column:
    """All keys that could list a url: its host, the domains above, and the page itself."""
    short = F.length(host) <= LONGEST_HOST
    end = F.right(host, F.lit(LONGEST_HOST))
    tail = F.when(short, host).otherwise(F.substr(end, F.instr(end, ".") + 1))
    labels = F.split(tail, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(above, F.array(host, F.concat(host, path)))))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, else nulls; of equally long ones the longer host wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        fits = rule.fits(host, path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def hashes(key: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a key."""
    return F.xxhash64(key), F.xxhash64(F.lit(2024), key)


@dataclass(frozen=True)
class Level:
    """One blocked Bloom filter: ``bits`` bits of a key in one of ``len(table)`` blocks."""

    number: int
    bits: int
    table: np.ndarray = field(repr=False)

    @staticmethod
    def places(number: int, blocks: int, bits: int, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block of every key, its bit numbers there: one row a key)."""
        with np.errstate(over="ignore"):
            x = mix(h1 ^ np.uint64(number * 0x9E3779B97F4A7C15 % (1 << 64)))
            y = mix(h2 + np.uint64(number * 0xC2B2AE3D27D4EB4F % (1 << 64)))
            block = ((x >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
            z = mix(y)
        at = [((y if j < 7 else z) >> np.uint64(9 * (j % 7))) & np.uint64(BLOCK_BITS - 1) for j in range(bits)]
        return block.astype(np.int64), np.stack(at, axis=1).astype(np.int64)

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        block, at = self.places(self.number, len(self.table), self.bits, h1, h2)
        found = np.ones(len(block), bool)
        for j in range(self.bits):
            found &= (self.table[block, at[:, j] >> 6] >> (at[:, j] & 63).astype(np.uint64)) & np.uint64(1) == 1
        return found


def listed(levels: Sequence[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether keys of the universe are listed: the first level that lacks a key decides, an odd one says no."""
    out = np.zeros(len(h1), bool)
    alive = np.arange(len(h1))
    for level in levels:
        if not len(alive):
            break
        there = level.holds(h1[alive], h2[alive])
        out[alive[~there]] = level.number % 2 == 0
        alive = alive[there]
    out[alive] = len(levels) % 2 == 1
    return out


def _longs(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column).view(np.uint64) if len(column) else np.zeros(0, np.uint64)


def _level_bits(wanted: float) -> int:
    """Bits a key for a false positive rate of about ``wanted``."""
    return min(MAX_KEY_BITS, max(1, round(-math.log2(max(wanted, 1e-9)))))


def _blocks(n: int, bits: int) -> int:
    return max(1, math.ceil(n * bits * 1.5 / BLOCK_BITS))


def _first_bits(n_listed: int, n_other: int) -> int:
    """The first level's rate: its false positives then number about half the listed keys."""
    return _level_bits(min(0.5, n_listed / max(1, 2 * n_other)))


def cascade_bytes(n_listed: int, n_other: int) -> int:
    """About the size of a cascade of so many keys."""
    first = _first_bits(n_listed, n_other)
    later = n_other / 2**first + n_listed / 2**LATER_BITS
    return (_blocks(n_listed, first) + _blocks(math.ceil(later * 1.2), LATER_BITS)) * BLOCK_BITS // 8


def _fill(keys: DataFrame, number: int, n: int, bits: int) -> Level:
    """The filter of all ``keys`` (h1, h2): tasks OR their own keys by block, an aggregation the rest."""
    blocks = _blocks(n, bits)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block, at = Level.places(number, blocks, bits, _longs(batch.column("h1")), _longs(batch.column("h2")))
            words = np.zeros((len(block), BLOCK_WORDS), np.uint64)
            rows = np.arange(len(block))
            for j in range(bits):
                words[rows, at[:, j] >> 6] |= np.uint64(1) << (at[:, j] & 63).astype(np.uint64)
            order = np.argsort(block, kind="stable")
            starts = np.flatnonzero(np.diff(block[order], prepend=-1))
            found = np.bitwise_or.reduceat(words[order], starts, axis=0).view(np.int64)
            names = ["block", *(f"w{k}" for k in range(BLOCK_WORDS))]
            yield pa.RecordBatch.from_arrays([pa.array(block[order][starts]), *(pa.array(np.ascontiguousarray(found[:, k])) for k in range(BLOCK_WORDS))], names=names)

    schema = ", ".join(["block long", *(f"w{k} long" for k in range(BLOCK_WORDS))])
    ored = keys.select("h1", "h2").mapInArrow(parts, schema).groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(BLOCK_WORDS)))
    made = ored.toArrow()  # a row a block: its number follows from n, checked by the caller
    table = np.zeros((blocks, BLOCK_WORDS), np.uint64)
    table[np.asarray(made.column("block"))] = np.stack([_longs(made.column(f"w{k}")) for k in range(BLOCK_WORDS)], axis=1)
    return Level(number, bits, table)


def _let_through(keys: DataFrame, level: Level) -> DataFrame:
    """The keys that a level holds, rightly or not."""
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.holds(_longs(batch.column("h1")), _longs(batch.column("h2")))))

    return keys.mapInArrow(through, keys.schema)


def build(universe: DataFrame, n_listed: int, n_other: int) -> list[Level]:
    """The cascade of a universe (h1, h2, listed: distinct keys), of which n_listed are listed."""
    store = Store(universe.sparkSession)
    keep = lambda df: store.put(df.select("h1", "h2"))
    inside, others, n = keep(universe.where("listed")), keep(universe.where("NOT listed")), n_listed
    levels: list[Level] = []
    while n:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("a listed key and another one have equal 128-bit hashes")
        level = _fill(inside, len(levels) + 1, n, LATER_BITS if levels else _first_bits(n_listed, n_other))
        levels.append(level)
        wrong = store.put(_let_through(others, level))
        store.drop(others)
        inside, others, n = wrong, inside, wrong.count()
    store.drop(inside, others)
    return levels


def mark(rows: DataFrame, keys: Column, listing: DataFrame, out: str = "listed", max_bytes: int = MAX_BYTES) -> DataFrame:
    """rows with a boolean column: whether any of a row's ``keys`` (array<string>) is in ``listing`` (key).

    ``out`` gets underscores in front if rows has that column.
    """
    (out,) = fresh(rows, out)
    asked, a, b = fresh(rows, "url_keys", "url_h1", "url_h2")
    store = Store(rows.sparkSession)
    rows = rows.withColumn(asked, F.coalesce(keys, F.array().cast("array<string>")))
    known = rows.select(F.explode(asked).alias("key"), F.lit(False).alias("listed"), F.lit(True).alias("asked"))
    wanted = listing.select(F.col(listing.columns[0]).cast("string").alias("key"), F.lit(True).alias("listed"), F.lit(False).alias("asked"))
    # Every key once; a list's keys that no row asks for are left out.
    every = known.unionByName(wanted).where("key IS NOT NULL").groupBy("key").agg(F.max("listed").alias("listed"), F.max("asked").alias("asked")).where("asked")
    h1, h2 = hashes(F.col("key"))
    every = store.put(every.select(h1.alias("h1"), h2.alias("h2"), "listed"))
    counts = {r["listed"]: r["count"] for r in every.groupBy("listed").count().collect()}
    n_listed, n_other = counts.get(True, 0), counts.get(False, 0)
    shards = max(1, math.ceil(cascade_bytes(n_listed, n_other) / max_bytes))
    rows = rows.withColumns({a: F.transform(asked, lambda k: hashes(k)[0]), b: F.transform(asked, lambda k: hashes(k)[1]), out: F.lit(False)}).drop(asked)
    shard_of = lambda h: F.pmod(F.shiftrightunsigned(h, 40), F.lit(shards))
    held = None
    for k in range(shards if n_listed else 0):
        part, n, m = every, n_listed, n_other
        if shards > 1:
            part = every.where(shard_of(F.col("h2")) == k)
            found = {r["listed"]: r["count"] for r in part.groupBy("listed").count().collect()}
            n, m = found.get(True, 0), found.get(False, 0)
        rows = _ask(rows, build(part, n, m), k, shards, a, b, out)
        if k < shards - 1:
            before, held = held, store.put(rows)
            rows = held
            if before is not None:
                store.drop(before)
    store.drop(every)
    return rows.drop(a, b)


def _ask(rows: DataFrame, levels: list[Level], k: int, shards: int, a: str, b: str, out: str) -> DataFrame:
    """Sets ``out`` where a row holds a listed key of shard k; rows are read batch by batch, nothing is shuffled."""
    shared = rows.sparkSession.sparkContext.broadcast(levels)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = batch.column(a), batch.column(b)
            h1, h2 = _longs(first.flatten()), _longs(second.flatten())
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(first.offsets)))
            mine = np.flatnonzero((h2 >> np.uint64(40)) % np.uint64(shards) == k)
            hit = mine[listed(shared.value, h1[mine], h2[mine])]
            marks = np.array(batch.column(out).to_numpy(zero_copy_only=False), bool)
            marks[row[hit]] = True
            yield batch.set_column(batch.schema.get_field_index(out), out, pa.array(marks))

    return rows.mapInArrow(ask, rows.schema)


def judge(pages: DataFrame, rules: Sequence[Rule], listing: DataFrame, url: str = "url", max_bytes: int = MAX_BYTES) -> DataFrame:
    """pages with host, path, rule (the longest that fits, else null) and verdict: the rule's, else ``block`` for listed urls, ``allow`` for others."""
    host, path, rule, said, verdict = fresh(pages, "host", "path", "rule", "url_said", "verdict")
    h, p = url_parts(F.col(url))
    rows = pages.withColumns({host: h, path: p})
    name, by_rule = longest_rule(F.col(host), F.col(path), rules)
    rows = rows.withColumns({rule: name, said: by_rule})
    (out,) = fresh(rows, "url_listed")
    rows = mark(rows, url_keys(F.col(host), F.col(path)), listing, out, max_bytes)
    return rows.withColumn(verdict, F.coalesce(said, F.when(F.col(out), "block").otherwise("allow"))).drop(said, out)


#: Words that put a key on the list of ``word_list`` (fixed values).
LISTED_WORDS = ("ads", "adult", "bets", "betting", "casino", "escort", "malware", "phishing", "pills", "poker", "porn", "sex", "spam", "viagra", "warez", "xxx")


def word_list(pages: DataFrame, url: str = "url", words: Sequence[str] = LISTED_WORDS) -> DataFrame:
    """(key): all hosts, domains and pages of a table that hold a listed word between other characters than a-z and 0-9."""
    host, path = url_parts(F.col(url))
    keys = pages.select(host.alias("host"), path.alias("path")).select(F.explode(url_keys(F.col("host"), F.col("path"))).alias("key"))
    return keys.where(F.arrays_overlap(F.split(ascii_lower(F.col("key")), "[^a-z0-9]+"), F.array(*map(F.lit, words)))).distinct()
