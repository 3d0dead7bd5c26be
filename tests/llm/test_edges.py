"""Empty tables, clashing names, very long texts and repeated rows for operators that had no such test."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import functions as F

from rulemark.llm import line_dedup, piece_codec, quality_model, quality_rules, secrets, topk, toxicity
from rulemark.llm.queries import token_model

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, n=40):
    rows = [(k, None if k == 5 else "" if k == 6 else f"good words number {k} stand here." if k % 2 else f"vile rot {k} vile rot.", "en", "s", 3) for k in range(n)]
    return spark.createDataFrame([*rows, rows[1]], SCHEMA)


def test_empty_tables(spark):
    none = docs(spark).where("false")
    assert piece_codec.encode_documents(none, token_model()).count() == 0
    assert secrets.find_secrets(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_documents(none, toxicity.fit(none, labels)).count() == 0
    scored = toxicity.score_documents(docs(spark), toxicity.fit(none, labels)).collect()
    assert len(scored) == 41 and all(0 <= r["score"] <= 1 for r in scored)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    import corpus_pipeline

    docs(spark).where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_names_stay(spark):
    df = docs(spark).withColumns({c: F.lit("mine") for c in ("quality", "score", "secrets", "gone", "ids", "n_tokens")})
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (1 - F.col("doc_id") % 2).cast("int").alias("toxic"))
    outs = [
        quality_rules.assess(df), piece_codec.encode_documents(df, token_model()), quality_model.score_documents(df, quality_model.fit(df, labels)), secrets.find_secrets(df),
        toxicity.score_documents(df, toxicity.fit(df, labels)),
    ]
    for out in outs:
        rows = out.collect()
        names = [c.lower() for c in out.columns]
        assert len(rows) == 41 and len(set(names)) == len(names) and len(names) > len(df.columns)
        assert {r["score"] for r in rows} == {r["quality"] for r in rows} == {r["gone"] for r in rows} == {"mine"}


def test_lines_go_under_clashing_names(spark):
    df = docs(spark).withColumns({c: F.lit("mine") for c in ("gone", "line", "class", "word")})
    out = line_dedup.dedup_lines(df, min_words=1)
    rows = out.collect()
    assert out.columns == df.columns and len(rows) == 41 and {(r["gone"], r["line"], r["class"], r["word"]) for r in rows} == {("mine",) * 4}


def test_vectors_with_clashing_names_and_repeats(spark):
    v = spark.createDataFrame([(k // 2, [float(k % 3), 1.0], 9, 9) for k in range(12)], "vec_id long, embedding array<double>, score int, rank int")
    out = topk.top_k(v, v.where("vec_id = 0"), k=3).collect()
    assert {r["query_id"] for r in out} == {0} and max(r["rank"] for r in out) <= 3 * 2


def test_very_long_texts(spark):
    long = "plain words follow here and there.\n" * 60000
    df = spark.createDataFrame([(1, long, "en", "s", 1), (2, "short and vile rot.", "en", "s", 1), (3, "good words.", "en", "s", 1)], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    q = {r["doc_id"]: r["quality"]["n_words"] for r in quality_rules.assess(df).collect()}
    assert q[1] == 360000
    for scored in (quality_model.score_documents(df, quality_model.fit(df, labels)), toxicity.score_documents(df, toxicity.fit(df, labels))):
        assert all(0 <= r["score"] <= 1 for r in scored.collect())
