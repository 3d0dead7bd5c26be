"""The contract queries of the operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemark.llm import conversations, importance, license_scan, line_dedup, mixing, ngram_join, piece_codec, quality_model, quality_rules, secrets, topk, toxicity, url_filter
from rulemark.llm.frames import crc_mod, small_batches
from rulemark.llm.oracle import CONVERSATIONS, IMPORTANCE, QUALITY_RULES, URL_FILTER


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    a = quality_rules.assess(docs)
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars", "n_lines_removed")
    return a.select("doc_id", *(F.col("quality")[c].alias(c) for c in fields))


def token_model() -> str:
    """The file of the public 32k piece model; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    a = piece_codec.encode_documents(docs, token_model(), ids=None, decimals="decimals", decoded="decoded", keep=["doc_id"])
    return a.select("doc_id", "n_tokens", F.sha2("decimals", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a file ``<source>/<doc_id>``; sources are the directories."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "doc_id").alias("path"), "text")
    return license_scan.scan(docs, keep=["doc_id", "path"])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, mixing.tempered_weights(docs))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality").where(crc_mod("doc_id", 5) != 0)
    model = quality_model.fit(docs, labels)
    scored = quality_model.score_documents(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
    found = line_dedup.marked(docs.withColumn("n_lines", lines), "gone", min_words=1, keep=["doc_id", "n_lines"])
    check = F.aggregate("gone", F.lit(0).cast("long"), lambda a, i: a + F.xxhash64(i) % 1000003)
    return found.select("doc_id", "n_lines", F.size("gone").cast("long").alias("n_removed"), check.alias("removed_check"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    a = secrets.find_secrets(docs, keep=["doc_id"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != "guess")
    return a.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.link_documents(docs, n=3, percent=90)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = lambda df: df.where(crc_mod("doc_id", 3) != 1)
    model = toxicity.fit(learn(docs), learn(_table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    scored = toxicity.score_documents(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: Explicit rules of the url filter; the longest that fits wins.
URL_RULES = (
    url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"), url_filter.Rule("block", "com", "/de/"),
)


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds the hosts, domains and pages of the table that are named by a listed word."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES, url_filter.word_list(pages)).drop("url")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("text")
    weighed = importance.weigh(docs, target, n=1, buckets=10000, keep=["doc_id"])
    return importance.draw(weighed, percent=10, seed=2024, min_words=20).select("doc_id", "n_features", "weight", "score", "rank")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.repair(rows, conversations.damage(rows))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_piece_codec": op2_piece_codec,
    "op3_license_scan": op3_license_scan,
    "op4_quality_model": op4_quality_model,
    "op5_mixing": op5_mixing,
    "op6_topk": op6_topk,
    "op7_line_dedup": op7_line_dedup,
    "op8_secrets": op8_secrets,
    "op9_ngram_join": op9_ngram_join,
    "op10_toxicity": op10_toxicity,
    "op11_url_filter": op11_url_filter,
    "op12_importance": op12_importance,
    "op13_conversations": op13_conversations,
}

#: DuckDB SQL over the same tables, for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": QUALITY_RULES,
    "op11_url_filter": URL_FILTER,
    "op12_importance": IMPORTANCE,
    "op13_conversations": CONVERSATIONS,
    "op9_ngram_join": """
        WITH RECURSIVE t AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ), g AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
            FROM t
        ), n AS (
            SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
        ), shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g AS a JOIN g AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), l AS (
            SELECT a, b FROM shared JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)
        ), both_ways AS (
            SELECT a, b FROM l UNION ALL SELECT b, a FROM l
        ), reach(a, b) AS (
            SELECT doc_id, doc_id FROM t
            UNION
            SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
        )
        SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
        FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) AS r USING (doc_id)
    """,
    "op6_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.c, v.c), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v AS q JOIN v ON q.vec_id <> v.vec_id
            WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS "rank", vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
    """,
}
