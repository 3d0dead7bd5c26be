"""From raw documents to mixed, tokenised training rows.

STAGES run in order, each on what the one before kept: quality rules, line
deduplication, near-duplicate removal, mixing of sources, encoding. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemark.llm import line_dedup, mixing, ngram_join, piece_codec, quality_rules
from rulemark.llm.frames import cut, small_batches
from rulemark.llm.queries import token_model


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without their failing lines."""
    return quality_rules.clean_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that match an earlier one; some may end empty."""
    small_batches(spark)
    return line_dedup.dedup_lines(docs, percent=80, min_words=1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 or more."""
    small_batches(spark)
    return ngram_join.keep_one(docs, n=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that holds the sources' target weights."""
    return mixing.mixed(docs, mixing.tempered_weights(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the text that they decode to."""
    small_batches(spark)
    rows = piece_codec.encode_documents(docs, token_model(), decoded="decoded", keep=["doc_id", "source"])
    return rows.select("doc_id", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("source mixing", mix),
    ("SentencePiece", encode),
]

#: SQL cannot express the tokenizer; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if k < len(STAGES) - 1:
            rows = cut(rows)
    return rows
