"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are positives; all other training text is unlabelled,
not clean. A linear numpy classifier minimises

    prior * R_p(+1)  +  max(0, R_u(-1) - prior * R_p(-1))

the class-prior-corrected risk with its negative part held at zero or above: a
step that would push it below walks back instead. Features are the presence of
words and of word beginnings (inflected forms share those), chosen by how much
oftener they stand in positives than in unlabelled text.

The model is fitted on bounded samples (``max_positive``, ``max_unlabelled``
documents with the smallest id hashes; ``max_terms`` features) and is the only
thing sent to the workers; every document is scored whole.

Defined results: null and empty texts hold no term and get the score of the bias
alone; rows are scored one by one; labels of documents that are absent and null
labels play no part; with no positive to learn from every score is the prior.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulemark.llm import textbatch as tb
from rulemark.llm.frames import cut, fresh

#: Bytes of a word's beginning that are features of their own.
BEGINNINGS = (4, 5, 6, 7, 8, 10)


@dataclass(frozen=True)
class Settings:
    max_positive: int = 4000
    max_unlabelled: int = 12000
    max_terms: int = 3000
    min_positive_docs: int = 4
    steps: int = 400
    rate: float = 0.15
    l2: float = 2e-4


def term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of the words of letters of a batch and of their beginnings."""
    data, offsets = tb.buffers(column)
    data = tb.lower_ascii(data)
    starts, ends, text_of = tb.words(data, offsets, tb.NOT_LETTER)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    parts = tb.span_hashes(data, starts, *(np.minimum(starts + k, ends) for k in BEGINNINGS), ends)
    longer = [ends - starts > k for k in BEGINNINGS] + [np.ones(len(starts), bool)]
    marks = [np.uint64(k) for k in (*BEGINNINGS, 0)]
    hashes = np.concatenate([tb.mix(h[m] + k) for h, m, k in zip(parts, longer, marks, strict=True)])
    return hashes, np.concatenate([text_of[m] for m in longer])


def _distinct(number: np.ndarray, text_of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, term number) pairs, sorted by text; absent terms dropped."""
    there = number >= 0
    pairs = np.unique(text_of[there] * width + number[there])
    return pairs // width, pairs % width


def _sampled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, s: Settings) -> DataFrame:
    """The bounded sample: text and whether it is a confirmed positive."""
    by = [F.xxhash64(F.col(doc_id)), F.col(doc_id)]
    positive = labels.where(F.col(label) == 1).select(F.col(doc_id)).distinct()
    positive = positive.orderBy(*by).limit(s.max_positive)
    other = docs.select(doc_id).where(F.col(doc_id).isNotNull()).distinct().orderBy(*by).limit(s.max_unlabelled)
    chosen = positive.withColumn("p", F.lit(1)).unionByName(other.withColumn("p", F.lit(0))).groupBy(doc_id).agg(F.max("p").alias("p"), (F.min("p") == 0).alias("u"))
    # At most max_positive + max_unlabelled ids: a bounded side to broadcast.
    return docs.select(doc_id, text).join(F.broadcast(chosen), doc_id).select(F.col(text).alias("text"), "p", "u", F.xxhash64(F.col(doc_id), F.col(text)).alias("key"))


@dataclass
class ToxicModel:
    terms: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        table = tb.TermTable(self.terms)
        hashes, text_of = term_hashes(column)
        total = np.full(len(column), self.bias)
        if len(hashes) and len(table):
            of, number = _distinct(table.find(hashes), text_of, len(table))
            total += np.bincount(of, self.weights[number], len(column))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(rows: list[np.ndarray], positive: np.ndarray, unlabelled: np.ndarray, prior: float, width: int, s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias minimising the non-negative risk; rows: each document's term numbers."""
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n_p, n_u = max(1, positive.sum()), max(1, unlabelled.sum())
    w, b = np.zeros(width), math.log(prior / (1 - prior))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, s.steps + 1):
        f = b + np.bincount(doc, w[flat], len(rows))
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        loss_neg = np.logaddexp(0, f)
        negative = (loss_neg * unlabelled).sum() / n_u - prior * (loss_neg * positive).sum() / n_p
        g_neg = unlabelled * p / n_u - prior * positive * p / n_p
        g = g_neg * (1 if negative >= 0 else -1) + (prior * positive * (p - 1) / n_p if negative >= 0 else 0)
        gw, gb = np.bincount(flat, g[doc], width) + s.l2 * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= s.rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= s.rate * (mb / c1) / (math.sqrt(vb / c2) + 1e-8)
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", settings: Settings = Settings()) -> ToxicModel:
    """Learns from docs (all of them may be used as unlabelled text) and labels (doc_id, label)."""
    s = settings
    labels = labels.select(doc_id, label).where(F.col(label).isNotNull())
    known = labels.agg(F.avg(F.col(label).cast("double")).alias("rate"), F.sum((F.col(label) == 1).cast("long")).alias("n")).first()
    prior = min(0.5, max(1e-3, known["rate"] if known["rate"] is not None else 0.05))
    nothing = ToxicModel(np.zeros(0, np.uint64), np.zeros(0), math.log(prior / (1 - prior)))
    if not known["n"]:
        return nothing
    sample = cut(_sampled(docs, labels, doc_id, text, label, s))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.pieces(batch):
                hashes, text_of = term_hashes(part.column("text"))
                if not len(hashes):
                    continue
                terms, number = np.unique(hashes, return_inverse=True)
                of, number = _distinct(number, text_of, len(terms))
                flags = [part.column(c).to_numpy(zero_copy_only=False).astype(float)[of] for c in ("p", "u")]
                in_p, in_u = (np.bincount(number, f, len(terms)).astype(np.int64) for f in flags)
                yield pa.RecordBatch.from_arrays([pa.array(terms.astype(np.int64)), pa.array(in_p), pa.array(in_u)], names=["term", "in_p", "in_u"])

    sizes = sample.agg(F.sum("p").alias("p"), F.sum(F.col("u").cast("int")).alias("u")).first()
    if not sizes["p"]:
        return nothing
    n_p, n_u = max(1, sizes["p"]), max(1, sizes["u"])
    counted = sample.mapInArrow(frequencies, "term long, in_p long, in_u long").groupBy("term").agg(F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u"))
    p, u = F.col("in_p") / n_p, (F.col("in_u") + 0.5) / (n_u + 1)
    strength = (p - u) / F.sqrt(u * (1 - u) / n_p + 1 / n_p**2)
    best = counted.where(F.col("in_p") >= min(s.min_positive_docs, max(1, n_p // 4))).orderBy(strength.desc(), "term").limit(s.max_terms).select("term")
    table = tb.TermTable(np.array([r["term"] for r in best.collect()], np.int64).astype(np.uint64))
    if not len(table):
        return nothing

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.pieces(batch):
                hashes, text_of = term_hashes(part.column("text"))
                of, number = _distinct(table.find(hashes), text_of, len(table))
                ends = np.searchsorted(of, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(number.astype(np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([lists, part.column("p"), part.column("u"), part.column("key")], names=["terms", "p", "u", "key"])

    # One short list a sampled document, so the sample's bound holds here too.
    # In an order of its own, so that the fit does not depend on files and partitions.
    got = sample.mapInArrow(vectors, "terms array<int>, p int, u boolean, key long").toArrow().sort_by("key")
    lists = got.column("terms").combine_chunks()
    rows = [np.asarray(x.values.to_numpy() if x.is_valid else [], np.int64) for x in lists]
    positive, unlabelled = (got.column(c).to_numpy().astype(float) for c in ("p", "u"))
    weights, bias = train(rows, positive, unlabelled, prior, len(table), s)
    return ToxicModel(table.hashes, weights, bias)


def score_documents(docs: DataFrame, model: ToxicModel, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all if None) with the probability that a text is toxic."""
    keep = docs.columns if keep is None else keep
    source = docs.select(*dict.fromkeys([*keep, text]))
    (out,) = fresh(docs, out)
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(out, T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.pieces(batch, text):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(model.scores(part.column(text)))], names=[*keep, out])

    return source.mapInArrow(work, schema)
