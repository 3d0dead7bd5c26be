"""Repair of conversations by the cheapest edits that make their turns grammatical.

Role initials must read ``(s?(ua)+)?``: perhaps one system turn, then user and
assistant by turns, or nothing. Blank and repeated turns must be deleted; others
may be kept, rerolled or deleted, and empty turns inserted. A forward Viterbi
programme walks a conversation with four grammar states (nothing yet, after s,
after u, after a), carries each state's least (cost, audit string), and closes
each turn's layer under the insertions of at most three turns. Equal costs take
the ASCII-least audit: two audits of one layer and equal cost never are prefixes
of each other, as the longer would have paid for its insertions, so the order
holds when both are continued, and one string a state is enough.

Conversations up to ``max_turns`` turns and ``max_bytes`` of text are grouped by
id and streamed through tasks, one held at a time. Larger ones are cut: a range
partitioning on (id, turn) gives every task a part; a part's programme run from
each of the four states is a 4 x 4 matrix of (cost, audit), and such matrices
multiply (min, +) in the order of the parts. The number of parts grows with the
conversation, no task holds it whole. Only its digest, which SHA-256 defines
from left to right, is taken by one task that streams the repaired turns.

Defined results: null values count as one space, in a missing turn number only
for its checksum: such turns come first, and rows of equal turn are ordered by
role, then text; a null conversation id is an id like any other; a conversation
without turns has zeros, an empty audit and the digest of the empty string; rows
that repeat are duplicates; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulemark.llm.frames import Store

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
#: Where an initial leads from each grammar state (0 nothing yet, 1 after s, 2 after u, 3 after a).
STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ACCEPTED = (0, 3)
MAX_TURNS, MAX_BYTES = 20_000, 32 << 20
SEPARATOR = "\x20\t\n\x0b\x0c\r"
#: Initials that may follow one another.
LEGAL = ("su", "ua", "au")
Layer = list[tuple[int, str] | None]


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", kinds: int = 20) -> DataFrame:
    """(conv_id, turn, role, text) after a checksum of id and turn has dropped, emptied, cut, repeated or rerolled a row, or let it be."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space(conv), space(turn)).cast("binary")) % kinds
    at = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"), kind.alias("kind"))
    body = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    at = at.where("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"), "kind")
    return at.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def fault_of(text: str, seen: bool) -> str:
    """A turn's first fault: blank, duplicate, truncated or none ('')."""
    solid = text.rstrip(SEPARATOR)
    return "blank" if not solid else "duplicate" if seen else "truncated" if solid[-1] not in ".!?" else ""


def _better(layer: Layer, state: int, cost: int, audit: str) -> None:
    if layer[state] is None or (cost, audit) < layer[state]:
        layer[state] = (cost, audit)


def closed(layer: Layer) -> Layer:
    """The layer with every run of insertions that could pay: none visits a state twice."""
    for _ in range(3):
        for state, best in enumerate(list(layer)):
            if best:
                for initial in "ua":
                    if state in STEP[initial]:
                        _better(layer, STEP[initial][state], best[0] + INSERT, best[1] + "I")
    return layer


def advance(layer: Layer, initial: str, fault: str) -> Layer:
    """The closed layer after one more turn."""
    after: Layer = [None] * 4
    extra = CUT_OFF if fault == "truncated" else 0
    for state, best in enumerate(layer):
        if not best:
            continue
        _better(after, state, best[0] + DELETE, best[1] + "D")
        if fault in ("blank", "duplicate"):
            continue
        if state in STEP.get(initial, ()):
            _better(after, STEP[initial][state], best[0] + KEEP + extra, best[1] + "K")
        for new in "ua":
            if state in STEP[new]:
                _better(after, STEP[new][state], best[0] + REROLE + extra, best[1] + "R")
    return closed(after)


def start(state: int = 0) -> Layer:
    layer: Layer = [None] * 4
    layer[state] = (0, "")
    return layer


def cheapest(turns: list[tuple[str, str]]) -> tuple[int, str]:
    """(cost, audit) of a conversation given as (role initial, fault)."""
    layer = closed(start())
    for initial, fault in turns:
        layer = advance(layer, initial, fault)
    return min(layer[s] for s in ACCEPTED if layer[s])


def repaired(audit: str, turns: Iterator[tuple[str, str]], state: int = 0) -> Iterator[tuple[str, str]]:
    """The turns (role, text) that an audit leaves, from a grammar state on."""
    turns = iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == 2 else "user"
        state = STEP[role[:1]][state]
        yield role, text


COUNTS = ("blank", "duplicate", "truncated", "illegal")
#: Turns after which what all of a layer's audits begin with is set aside, so that they stay short.
COMMIT = 256


class _Walk:
    """A layer and the common beginning of its audits."""

    def __init__(self, layer: Layer):
        self.layer, self.done = layer, []

    def commit(self) -> None:
        shared = os.path.commonprefix([best[1] for best in self.layer if best])
        if shared:
            self.done.append(shared)
            self.layer = [best and (best[0], best[1][len(shared) :]) for best in self.layer]

    def best(self, states: tuple[int, ...]) -> tuple[int, str]:
        cost, audit = min(self.layer[s] for s in states if self.layer[s])
        return cost, "".join([*self.done, audit])


class _Counts:
    """What is counted along a conversation's turns, and the programme's walks from each wanted state."""

    def __init__(self, states: tuple[int, ...]):
        self.counts = dict.fromkeys(COUNTS, 0)
        self.first, self.last, self.turns = None, None, 0
        # Insertions before the first turn belong to the conversation, not to a part.
        self.walks = [_Walk(closed(start(s)) if len(states) == 1 else start(s)) for s in states]

    def add(self, role: str, text: str, seen: bool) -> None:
        fault, initial = fault_of(text, seen), role[:1]
        if fault:
            self.counts[fault] += 1
        if self.turns:
            self.counts["illegal"] += self.last + initial not in LEGAL
        else:
            self.first = initial
        self.last, self.turns = initial, self.turns + 1
        for walk in self.walks:
            walk.layer = advance(walk.layer, initial, fault)
            if self.turns % COMMIT == 0:
                walk.commit()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _groups(rows: Iterator[dict], *keys: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of rows of equal keys in a sorted stream, a row ahead in memory at a time."""
    held = [next(rows, None)]
    of = lambda row: tuple(row[k] for k in keys)

    def run(value: tuple) -> Iterator[dict]:
        while held[0] is not None and of(held[0]) == value:
            row, held[0] = held[0], next(rows, None)
            yield row

    while held[0] is not None:
        value = of(held[0])
        group = run(value)
        yield value, group
        for _ in group:
            pass


def _task(solve, fields: dict[str, str]):
    """A function for mapInArrow from ``solve``, which turns rows into rows of ``fields``, and Spark's schema of the result."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(", ".join(f"{k} {v}" for k, v in fields.items()))
    arrow = pa.schema([(k, _ARROW[v]) for k, v in fields.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row in solve(_rows(batches)):
            out.append(row)
            size += 100 + len(row.get("audit", ""))
            if size > 1 << 20:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return run, schema


CELLS = "array<struct<a: int, b: int, cost: bigint, audit: string>>"
_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string(),
    CELLS: pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])),
}


def _longs(*names: str) -> dict[str, str]:
    return dict.fromkeys(names, "bigint")


def _small(damaged: DataFrame, kind: str) -> DataFrame:
    """Whole conversations, one in memory at a time; their number of turns and bytes is bounded by the caller."""

    def solve(rows: Iterator[dict]) -> Iterator[dict]:
        for (conv,), group in _groups(rows, "conv_id"):
            turns = [(r["turn"], r["role"], r["text"]) for r in group]
            counts, seen, numbers = _Counts((0,)), set(), {t for t, _, _ in turns if t is not None}
            for _, role, text in turns:
                counts.add(role, text, (role, text) in seen)
                seen.add((role, text))
            cost, audit = counts.walks[0].best(ACCEPTED)
            body = "\n".join(f"{role}:{text}" for role, text in repaired(audit, ((r, t) for _, r, t in turns)))
            gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
            yield {"conv_id": conv, "gaps": gaps, **counts.counts, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(body.encode()).hexdigest()}

    run, schema = _task(solve, {"conv_id": kind, **_longs("gaps", *COUNTS, "cost"), "audit": "string", "repaired_sha256": "string"})
    return damaged.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").mapInArrow(run, schema)


def _large(damaged: DataFrame, kind: str) -> DataFrame:
    """Conversations of any size, cut into parts by ranges of turns."""
    store = Store(damaged.sparkSession)
    rows = store.put(damaged.withColumn("tag", F.monotonically_increasing_id()).withColumn("digest", F.sha2(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"), 256)))
    # The first row of each text decides; rows of one text meet as one row a task, not as a group.
    place = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "tag")
    first = rows.groupBy("conv_id", "digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("of"), "digest", F.col("first.tag").alias("first"))
    again = rows.select("conv_id", "tag", "digest").join(first, ["digest"]).where(F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("tag") != F.col("first"))).select("tag", F.lit(True).alias("seen"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "tag"]
    ranged = rows.join(again, "tag", "left").select("conv_id", "turn", "role", "text", "tag", F.coalesce("seen", F.lit(False)).alias("seen"))
    # Written in parts: a part's number is its task's, and parts ascend with the order.
    ranged = store.put(ranged.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()).drop("tag"))
    ranged = ranged.withColumn("part", F.shiftright("place", 33))

    def summaries(rows: Iterator[dict]) -> Iterator[dict]:
        for (part, conv), group in _groups(rows, "part", "conv_id"):
            counts = _Counts((0, 1, 2, 3))
            for r in group:
                counts.add(r["role"], r["text"], r["seen"])
            cells = [{"a": a, "b": b, "cost": best[0], "audit": "".join([*walk.done, best[1]])} for a, walk in enumerate(counts.walks) for b, best in enumerate(walk.layer) if best]
            yield {"conv_id": conv, "part": part, **counts.counts, "first": counts.first, "last": counts.last, "cells": cells}

    run, schema = _task(summaries, {"conv_id": kind, **_longs("part", *COUNTS), "first": "string", "last": "string", "cells": CELLS})
    parts = store.put(ranged.repartition("part").sortWithinPartitions("place").select("conv_id", "part", "role", "text", "seen").mapInArrow(run, schema))
    return _joined(ranged, parts, kind)


def _joined(ranged: DataFrame, parts: DataFrame, kind: str) -> DataFrame:
    """Multiplies the parts' matrices in order, then streams the repaired turns into the digest."""

    def product(rows: Iterator[dict]) -> Iterator[dict]:
        for (conv,), group in _groups(rows, "conv_id"):
            total, last, walk = dict.fromkeys(COUNTS, 0), None, _Walk(closed(start()))
            for r in group:
                for name in COUNTS:
                    total[name] += r[name]
                total["illegal"] += last is not None and last + r["first"] not in LEGAL
                last, after = r["last"], [None] * 4
                for c in r["cells"]:
                    before = walk.layer[c["a"]]
                    if before:
                        _better(after, c["b"], before[0] + c["cost"], before[1] + c["audit"])
                walk.layer = after
                walk.commit()
            cost, audit = walk.best(ACCEPTED)
            yield {"conv_id": conv, **total, "cost": cost, "audit": audit}

    def digests(rows: Iterator[dict]) -> Iterator[dict]:
        for (conv,), group in _groups(rows, "conv_id"):
            audit, sha, between = next(group)["audit"], hashlib.sha256(), ""
            for role, text in repaired(audit, ((r["role"], r["text"]) for r in group)):
                sha.update(f"{between}{role}:{text}".encode())
                between = "\n"
            yield {"conv_id": conv, "repaired_sha256": sha.hexdigest()}

    run, schema = _task(product, {"conv_id": kind, **_longs(*COUNTS, "cost"), "audit": "string"})
    solved = Store(ranged.sparkSession).put(parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, schema))
    # The audit goes ahead of the turns, which follow in order.
    nothing = F.lit(None).cast("string")
    head = solved.select("conv_id", F.lit(-1).cast("long").alias("place"), nothing.alias("role"), nothing.alias("text"), "audit")
    stream = head.unionByName(ranged.select("conv_id", "place", "role", "text", nothing.alias("audit")))
    run, schema = _task(digests, {"conv_id": kind, "repaired_sha256": "string"})
    told = stream.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(run, schema).withColumnRenamed("conv_id", "told_id")
    span = ranged.groupBy("conv_id", "turn").agg(F.lit(1)).groupBy(F.col("conv_id").alias("span_id")).agg(F.max("turn").alias("high"), F.min("turn").alias("low"), F.count("turn").alias("n"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n"), F.lit(0)).cast("long")
    joined = solved.join(told, F.col("conv_id").eqNullSafe(F.col("told_id"))).join(span, F.col("conv_id").eqNullSafe(F.col("span_id")))
    return joined.select("conv_id", gaps.alias("gaps"), *COUNTS, "cost", "audit", "repaired_sha256")


def repair(rows: DataFrame, damaged: DataFrame, conv: str = "conv_id", max_turns: int = MAX_TURNS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """A row a conversation of ``rows``: faults of its turns in ``damaged`` (conv_id, turn, role, text), the cheapest edits, and the repaired text's digest."""
    kind = damaged.schema["conv_id"].dataType.simpleString()
    store = Store(damaged.sparkSession)
    size = F.octet_length("role") + F.octet_length("text")
    counted = damaged.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(size.cast("long")).alias("bytes"))
    large = store.put(counted.where((F.col("n") > max_turns) | (F.col("bytes") > max_bytes)).select(F.col("conv_id").alias("large_id")))
    is_large = damaged["conv_id"].eqNullSafe(large["large_id"])
    solved = _small(damaged.join(large, is_large, "left_anti"), kind)
    if large.limit(1).count():
        solved = solved.unionByName(_large(damaged.join(large, is_large, "left_semi"), kind))
    solved = solved.withColumnRenamed("conv_id", "solved_id")
    ids = rows.select(F.col(conv).alias("conv_id")).distinct()
    none: dict[str, Column] = {c: F.lit(0).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    none |= {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return ids.join(solved, ids["conv_id"].eqNullSafe(solved["solved_id"]), "left").select("conv_id", *(F.coalesce(c, d).alias(c) for c, d in none.items()))
