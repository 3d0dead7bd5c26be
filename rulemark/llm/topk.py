"""Exact top-k inner products on a bit-sliced index.

Candidates are cut into blocks. A block keeps, for every dimension, the bits of
all its rows' integer components as bitmaps (slices). A query's scores are then
sums of slices by bitmap arithmetic: each set bit of a query component adds the
dimension's slices at that weight, three bitmaps of one weight becoming a sum
and a carry, so all rows of the block are added at once. The k best rows are
picked from the most significant slice of the sum downward; rows tied at the
boundary are resolved exactly, by their ids, and the winners' scores are
recomputed from the components. Block winners merge by rank.

Query blocks meet candidate blocks pairwise; each task holds one block of each,
and every block sends k rows a query on, so no step grows with a group.

Components up to ``LIMIT`` are 32-bit integers. A vector with a larger one travels
as doubles beside them; its columns get as many slices as their integers have
bits, and scores are then summed in Python's integers, so any finite vector is
ranked exactly.

Defined results: vectors that are null, or hold a null or a non-finite component
take no part, nor do rows without an id; a score outside 64 bits ranks by its
exact value and is given as null, for the column cannot hold it; vectors of other lengths are not comparable and meet only their own kind;
equal ids are candidates of one another never (a row is not its own candidate);
with fewer candidates than k all are returned, ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Scaled components below it are 32-bit integers, whose products, summed over a vector, stay exact in 64 bits.
LIMIT = 1 << 26
CANDIDATES, QUERIES = 1 << 16, 512


def scaled(vector: Column, factor: int) -> tuple[Column, Column]:
    """floor(factor * x) of every component, in double arithmetic, where all are below LIMIT, and else the components.

    Both are null where the vector takes no part, one of them elsewhere.
    """
    doubles = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))
    small = F.forall(doubles, lambda x: F.abs(x * factor) < LIMIT)
    return F.when(sound & small, F.transform(doubles, lambda x: F.floor(x * factor).cast("int"))), F.when(sound & ~small, doubles)


def _whole(x: float, factor: int) -> int:
    """floor(factor * x) as an integer of any size."""
    product = x * factor
    return math.floor(product) if math.isfinite(product) else int(x) * factor


def _columns(narrow: pd.Series, wide: pd.Series, factor: int) -> list[np.ndarray]:
    """The block's components by dimension, in 64 bits where they fit (with room for a difference), else as objects."""
    large = wide.notna().to_numpy()
    small = np.stack(narrow[~large].to_numpy()).astype(np.int64) if not large.all() else None
    out = []
    for d in range(len((wide if small is None else narrow[~large]).iloc[0])):
        whole = [_whole(w[d], factor) for w in wide[large]]
        column = np.zeros(len(large), np.int64 if all(-(1 << 62) < x < 1 << 62 for x in whole) else object)
        column[large] = whole
        if small is not None:
            column[~large] = small[:, d].tolist()
        out.append(column)
    return out


def _planes(column: np.ndarray) -> list[np.ndarray]:
    """Bitmaps of a column's values above its minimum, lowest bit first."""
    raised = column - column.min()
    if raised.dtype == object:
        bits = int(raised.max()).bit_length()
        size = -(-bits // 8)
        raw = np.frombuffer(b"".join(x.to_bytes(size, "little") for x in raised), np.uint8).reshape(len(raised), size)
        rows_of_bits = (raw[:, b >> 3] >> np.uint8(b & 7) & np.uint8(1) for b in range(bits))
    else:
        raised = raised.astype(np.uint64)
        rows_of_bits = ((raised >> np.uint64(b)) & np.uint64(1) for b in range(int(raised.max()).bit_length()))
    planes = []
    for on in rows_of_bits:
        packed = np.packbits(on == 1, bitorder="little")
        planes.append(np.frombuffer(np.pad(packed, (0, -len(packed) % 8)).tobytes(), np.uint64))
    return planes


def _digits(value: int) -> list[tuple[int, int]]:
    """Non-adjacent form: (bit, sign) of the fewest signed powers of two."""
    out, k = [], 0
    while value:
        if value & 1:
            sign = 2 - (value & 3)
            out.append((k, sign))
            value -= sign
        value >>= 1
        k += 1
    return out


def _sum_slices(planes: list[list[np.ndarray]], flipped: list[list[np.ndarray]], query: list[int], words: int) -> list[np.ndarray]:
    """Slices of the query's score in every row, up to one constant for the block."""
    by_weight: list[list[np.ndarray]] = []
    for own, other, q in zip(planes, flipped, query, strict=True):
        for bit, sign in _digits(q):
            # Minus a number is its complement plus a constant, which orders rows alike.
            for b, plane in enumerate(own if sign > 0 else other):
                while len(by_weight) <= bit + b:
                    by_weight.append([])
                by_weight[bit + b].append(plane)
    out, w = [], 0
    xor, and_, or_ = np.bitwise_xor, np.bitwise_and, np.bitwise_or
    while w < len(by_weight):
        here = by_weight[w]
        if len(here) > 1 and w + 1 == len(by_weight):
            by_weight.append([])
        while len(here) > 2:
            a, b, c = here.pop(), here.pop(), here.pop()
            ab = xor(a, b)
            here.insert(0, xor(ab, c))
            carry = and_(a, b)
            by_weight[w + 1].append(or_(carry, and_(ab, c), out=carry))
        if len(here) == 2:
            a, b = here
            by_weight[w + 1].append(and_(a, b))
            here[:] = [xor(a, b)]
        out.append(here[0] if here else np.zeros(words, np.uint64))
        w += 1
    return out


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def _select(slices: list[np.ndarray], among: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows surely in, rows tied at the boundary, how many of those are wanted)."""
    sure, tied = np.zeros_like(among), among
    n_sure = 0
    for s in reversed(slices):
        high = tied & s
        n = n_sure + _count(high)
        if n > k:
            tied = high
        else:
            sure = sure | high
            n_sure, tied = n, tied & ~s
            if n == k:
                return sure, np.zeros_like(among), 0
    return sure, tied, k - n_sure


def _rows(bitmap: np.ndarray, first: int | None = None) -> np.ndarray:
    """Positions of set bits, the first few if so asked."""
    if first is not None:
        filled = np.flatnonzero(bitmap)
        enough = np.searchsorted(np.cumsum(np.bitwise_count(bitmap[filled])), first) + 1
        cut = np.zeros_like(bitmap)
        cut[filled[:enough]] = bitmap[filled[:enough]]
        bitmap = cut
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))[:first]


def search_block(ids: np.ndarray, values: np.ndarray | list[np.ndarray], query_ids: np.ndarray, queries: np.ndarray | list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of each query's k best rows of one block.

    values and queries are matrices of 64-bit integers, or both lists of columns
    of integers of any size; the scores are then Python's integers.
    """
    order = np.argsort(ids, kind="stable")  # so that the first of tied rows have the smaller ids
    ids, wide = ids[order], isinstance(values, list)
    if wide:
        values = [column[order] for column in values]
        vectors = [[int(column[i]) for column in queries] for i in range(len(query_ids))]
        score = lambda rows, q: np.array([sum(int(column[r]) * x for column, x in zip(values, q, strict=True)) for r in rows], object)
        planes = [_planes(column) for column in values]
    else:
        values = values[order].astype(np.int64)
        vectors = queries.astype(np.int64).tolist()
        score = lambda rows, q: values[rows] @ np.array(q, np.int64)
        planes = [_planes(column) for column in values.T]
    flipped = [[~p for p in own] for own in planes]
    words = -(-len(ids) // 64)
    everyone = np.frombuffer(np.pad(np.packbits(np.ones(len(ids), bool), bitorder="little"), (0, words * 8 - -(-len(ids) // 8))).tobytes(), np.uint64)
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q, vector in zip(query_ids, vectors, strict=True):
        among = everyone
        a, b = np.searchsorted(ids, q, "left"), np.searchsorted(ids, q, "right")
        if a < b:
            among = everyone.copy()
            for at in range(a, b):
                among[at >> 6] &= ~(np.uint64(1) << np.uint64(at & 63))
        slices = _sum_slices(planes, flipped, vector, words)
        sure, tied, wanted = _select(slices, among, k)
        rows = _rows(sure)
        if wanted:
            rows = np.append(rows, _rows(tied, wanted))
        got.append((np.full(len(rows), q), ids[rows], score(rows, vector)))
    return tuple(np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.int64) for i in range(3))


def _sortable(score: int) -> bytes:
    """Bytes that sort like the scores outside 64 bits: sign, length, digits; complements if negative."""
    size = -(-abs(score).bit_length() // 8)
    raw = b"\xff" + size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return raw if score > 0 else bytes(255 - b for b in raw)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", factor: int = 64) -> DataFrame:
    """(query_id, rank, <id>, score): the k candidates of highest score of each query row."""

    def plain(df: DataFrame) -> DataFrame:
        v, wide = scaled(F.col(vector), factor)
        own = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), wide.alias("wide"))
        return own.withColumn("n", F.size(F.coalesce("v", "wide"))).where("id IS NOT NULL AND coalesce(v, wide) IS NOT NULL")

    c, q = plain(candidates), plain(queries)
    blocks = lambda df, size: max(1, -(-df.count() // size))
    n_c, n_q = blocks(c, CANDIDATES), blocks(q, QUERIES)
    place = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    # Every block of one side meets every block of the other: a grid, not a cross of rows.
    left = c.withColumn("i", place(n_c, 1)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    right = q.withColumn("j", place(n_q, 2)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))

    def search(_key: tuple, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "id": [], "score": [], "big": []})
        if rows["wide"].isna().all() and asked["wide"].isna().all():
            block = lambda df: np.stack(df["v"].to_numpy())
        else:
            block = lambda df: _columns(df["v"], df["wide"], factor)
        of, ids, scores = search_block(rows["id"].to_numpy(), block(rows), asked["id"].to_numpy(), block(asked), k)
        if scores.dtype != object:
            return pd.DataFrame({"query_id": of, "id": ids, "score": scores, "big": None})
        fits = [-(1 << 63) <= s < 1 << 63 for s in scores]
        return pd.DataFrame({"query_id": of, "id": ids, "score": pd.array([s if f else None for s, f in zip(scores, fits, strict=True)], "Int64"), "big": [None if f else _sortable(s) for s, f in zip(scores, fits, strict=True)]})

    keys = ("n", "i", "j")
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, id long, score long, big binary")
    # Scores within 64 bits stand between the positive and the negative ones beyond.
    big = F.coalesce("big", F.lit(bytes([128])))
    w = Window.partitionBy("query_id").orderBy(big.desc(), F.col("score").desc(), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
