"""Document quality from random-indexing word vectors and a small network.

Every term has a sparse ternary index vector given by its hash, so no vocabulary
is held and no term is cut. A term's context is the sum of its neighbours' index
vectors over all documents, kept in a table of ``slots`` rows that the term's
hash chooses: the table's size is fixed, whatever the corpus, and rare terms that
share a row share a context but keep their own index vectors. A term's vector is
its index vector plus its context, each scaled to length one; a document is the
mean of its terms' vectors. Two numpy layers turn that into a logit, and one
temperature, fitted on documents kept out of the training, calibrates the
probabilities.

Terms are words (ASCII case folded), their shapes (runs of capitals, letters,
digits and each symbol) and whether a word repeats the one before.

Only the network is fitted on a bounded sample (``max_fit_rows`` labelled
documents with the smallest id hashes); contexts are whole numbers summed over
every document, so files and partitions change nothing. The table of contexts
(``slots`` * ``width`` floats) is all that goes to the workers.

Defined results: null and empty texts are the zero vector, so they all get one
score; rows are scored one by one; documents without a label and null labels
play no part in fitting the network; with labels of one kind only, every score
is that label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulemark.llm import textbatch as tb
from rulemark.llm.frames import cut, fresh


@dataclass(frozen=True)
class Settings:
    max_fit_rows: int = 6000
    slots: int = 1 << 15
    width: int = 96
    nonzero: int = 8
    window: int = 2
    hidden: int = 24
    epochs: int = 60
    batch: int = 256
    rate: float = 0.01
    l2: float = 1e-4
    calibration_percent: int = 20
    seed: int = 7


_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = ord("A"), ord("a"), ord("0"), ord("a")


def term_hashes(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hash, text index) of each kind of term, in text order: words, shapes, repeats."""
    data, offsets = tb.buffers(column)
    starts, ends, text_of = tb.words(data, offsets)
    if not len(starts):
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return [none, none, none]
    words = tb.word_hashes(tb.lower_ascii(data), starts, ends)
    kinds = _CLASS[data]
    keep = np.ones(len(data), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[starts] = True
    at = np.append(0, np.cumsum(keep))
    shapes = tb.mix(tb.word_hashes(kinds[keep], at[starts], at[ends]) + np.uint64(1))
    again = np.flatnonzero((words[1:] == words[:-1]) & (text_of[1:] == text_of[:-1])) + 1
    return [(words, text_of), (shapes, text_of), (np.full(len(again), 0x5EED, np.uint64), text_of[again])]


def index_places(hashes: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the entries of each term's sparse ternary vector."""
    places, signs = (np.empty((len(hashes), s.nonzero), t) for t in (np.int64, np.int32))
    h = hashes
    for k in range(s.nonzero):
        h = tb.mix(h + np.uint64(0x9E3779B97F4A7C15))
        places[:, k] = (h >> np.uint64(33)).astype(np.int64) % s.width
        signs[:, k] = np.where(h & np.uint64(1), 1, -1)
    return places, signs


def slot_of(hashes: np.ndarray, s: Settings) -> np.ndarray:
    """The row of the context table that each term has."""
    return (hashes % np.uint64(s.slots)).astype(np.int64)


#: Pairs worked on at a time; bounds the temporaries.
PAIRS = 1 << 16


@dataclass
class QualityModel:
    settings: Settings
    contexts: np.ndarray
    layers: tuple
    temperature: float

    def pooled(self, column: pa.Array) -> np.ndarray:
        """The mean term vector of each text, over all its terms."""
        s = self.settings
        out = np.zeros((len(column), s.width))
        hashes, of = (np.concatenate(x) for x in zip(*term_hashes(column), strict=True))
        if not len(hashes):
            return out
        terms, number = np.unique(hashes, return_inverse=True)
        places, signs = index_places(terms, s)
        slots = slot_of(terms, s)
        # Count each text's terms first: vectors are then added once a distinct term.
        pairs, times = np.unique(of * len(terms) + number, return_counts=True)
        for at in range(0, len(pairs), PAIRS):
            doc, number = pairs[at : at + PAIRS] // len(terms), pairs[at : at + PAIRS] % len(terms)
            n, first = times[at : at + PAIRS, None], np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            out[doc[first]] += np.add.reduceat(self.contexts[slots[number]] * n.astype(np.float32), first, axis=0)
            low, high = doc[0], doc[-1] + 1
            own = np.bincount(((doc - low)[:, None] * s.width + places[number]).ravel(), (signs[number] * n).ravel(), (high - low) * s.width)
            out[low:high] += own.reshape(-1, s.width) / np.sqrt(s.nonzero)
        return out / np.maximum(np.bincount(of, minlength=len(column)), 1)[:, None]

    def scores(self, column: pa.Array) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.layers
        x = (self.pooled(column) - mean) / scale
        logit = np.tanh(x @ w1 + b1) @ w2 + b2
        return 1 / (1 + np.exp(-np.clip(logit / self.temperature, -30, 30)))


def add_neighbours(total: np.ndarray, column: pa.Array, s: Settings) -> None:
    """Adds to total (slots * width, flat) the index vectors of every term's neighbours in the texts."""
    for hashes, of in term_hashes(column)[:2]:
        terms, number = np.unique(hashes, return_inverse=True)
        places, signs = index_places(terms, s)
        rows = slot_of(terms, s) * s.width
        for k in range(1, s.window + 1):
            same = of[:-k] == of[k:]
            pairs, times = np.unique(number[:-k][same] * len(terms) + number[k:][same], return_counts=True)
            for at in range(0, len(pairs), PAIRS):
                left, right = pairs[at : at + PAIRS] // len(terms), pairs[at : at + PAIRS] % len(terms)
                n = times[at : at + PAIRS, None].astype(np.int32)
                for to, by in ((left, right), (right, left)):
                    np.add.at(total, (rows[to][:, None] + places[by]).ravel(), (signs[by] * n).ravel())


def _rows(total: np.ndarray, s: Settings) -> Iterator[pa.RecordBatch]:
    """The rows of a table of sums that hold anything, as (slot, bytes of its numbers)."""
    table = total.reshape(s.slots, s.width)
    at = np.flatnonzero(table.any(axis=1))
    size = s.width * table.itemsize
    for k in range(0, len(at), 4096):
        part = at[k : k + 4096]
        offsets = (np.arange(len(part) + 1) * size).astype(np.int32)
        values = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(table[part].tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), values], names=["slot", "sums"])


def contexts(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> np.ndarray:
    """The context table (slots, width) of all texts of docs, its rows scaled to length one.

    Each task sums its own documents into one table of fixed size; the rows of these
    are dealt by slot and added as they stream in, so no group is ever held.
    """
    s = settings

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(s.slots * s.width, np.int32)
        for batch in batches:
            for part in tb.pieces(batch):
                add_neighbours(total, part.column("text"), s)
        yield from _rows(total, s)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((s.slots, s.width), np.int64)
        for batch in batches:
            slots = batch.column("slot").to_numpy()
            sums = np.frombuffer(b"".join(batch.column("sums").to_pylist()), np.int32).reshape(-1, s.width)
            np.add.at(total, slots, sums)
        yield from _rows(total, s)

    parts = docs.select(F.col(text).alias("text")).mapInArrow(partial, "slot int, sums binary")
    got = parts.repartition("slot").mapInArrow(added, "slot int, sums binary").toArrow()
    out = np.zeros((s.slots, s.width), np.float32)
    # At most ``slots`` rows reach the driver.
    sums = np.frombuffer(b"".join(got.column("sums").to_pylist()), np.int64).reshape(-1, s.width).astype(float)
    out[got.column("slot").to_numpy()] = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return out


def train(x: np.ndarray, y: np.ndarray, s: Settings) -> tuple[tuple, float]:
    """Two layers by Adam, then the temperature on the rows kept out."""
    rng = np.random.default_rng(s.seed)
    order = rng.permutation(len(x))
    held = order[: len(x) * s.calibration_percent // 100]
    used = order[len(held) :]
    mean, scale = x[used].mean(0), x[used].std(0) + 1e-6
    z = (x - mean) / scale
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], s.hidden)), np.zeros(s.hidden), rng.normal(0, 1 / np.sqrt(s.hidden), s.hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(s.epochs):
        rng.shuffle(used)
        for a in range(0, len(used), s.batch):
            rows = used[a : a + s.batch]
            h = np.tanh(z[rows] @ params[0] + params[1])
            f = h @ params[2] + params[3][0]
            g = (1 / (1 + np.exp(-np.clip(f, -30, 30))) - y[rows]) / len(rows)
            gh = np.outer(g, params[2]) * (1 - h * h)
            grads = [z[rows].T @ gh + s.l2 * params[0], gh.sum(0), h.T @ g + s.l2 * params[2], np.array([g.sum()])]
            step += 1
            for k, grad in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad * grad
                params[k] -= s.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    logit = np.tanh(z[held] @ params[0] + params[1]) @ params[2] + params[3][0]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 81))
    loss = [np.logaddexp(0, logit / t).mean() - (y[held] * logit / t).mean() for t in grid] if len(held) else [0.0]
    return (mean, scale, params[0], params[1], params[2], float(params[3][0])), float(grid[int(np.argmin(loss))]) if len(held) else 1.0


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", settings: Settings = Settings()) -> QualityModel:
    """Contexts from all docs, the network from those that labels (doc_id, label 0 or 1) names."""
    s = settings
    chosen = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64(F.col(doc_id)), F.col(doc_id)).limit(s.max_fit_rows)
    # max_fit_rows ids at most: a bounded side to broadcast.
    sample = cut(docs.select(doc_id, F.col(text).alias("text")).join(F.broadcast(chosen), doc_id).select("text", "y", F.xxhash64(F.col(doc_id), F.col("text")).alias("key")))

    model = QualityModel(s, contexts(docs, text, s), (), 1.0)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.pieces(batch):
                x = model.pooled(part.column("text")).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * s.width).astype(np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([lists, part.column("y"), part.column("key")], names=["x", "y", "key"])

    # In an order of its own, so that the fit does not depend on files and partitions.
    got = sample.mapInArrow(pooled, "x array<float>, y int, key long").toArrow().sort_by("key")
    y = got.column("y").to_numpy().astype(float)
    x = got.column("x").combine_chunks().values.to_numpy().astype(float).reshape(-1, s.width) if len(y) else np.zeros((0, s.width))
    if len(set(y.tolist())) < 2:
        sure = 30.0 * (2 * y[0] - 1) if len(y) else 0.0
        model.layers = (np.zeros(s.width), np.ones(s.width), np.zeros((s.width, 1)), np.zeros(1), np.zeros(1), sure)
        return model
    model.layers, model.temperature = train(x, y, s)
    return model


def score_documents(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all if None) with the probability that a text is good."""
    keep = docs.columns if keep is None else keep
    source = docs.select(*dict.fromkeys([*keep, text]))
    (out,) = fresh(docs, out)
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(out, T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.pieces(batch, text):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(model.scores(part.column(text)))], names=[*keep, out])

    return source.mapInArrow(work, schema)
