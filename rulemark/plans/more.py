"""Queries on keys, panels, mandates, histories and reweighted references."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rulemark.functions import identifiers as ids
from rulemark.functions import numbers
from rulemark.functions import text as words
from rulemark.operators import documents, prices, sampling
from rulemark.operators.cuts import cut
from rulemark.plans.portfolio import K, SAMPLES_SQL, samples, universe_assets
from rulemark.plans.registry import query
from rulemark.plans.text import clauses
from rulemark.sources.tables import assets, filings, holdings, index_holdings, read, report_dates, sql

R = F.round


@query("accession_normalised", r"""
    WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN 'x' ELSE '' END || lpad(CAST(o_custkey AS VARCHAR), 10, '0') || CASE o_orderkey % 4 WHEN 0 THEN '-' ELSE '' END || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || CASE o_orderkey % 4 WHEN 0 THEN '-' ELSE '' END || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS raw FROM orders)
    SELECT o_orderkey, CASE WHEN regexp_full_match(raw, '\d{10}-?\d{2}-?\d{6}') THEN regexp_replace(raw, '^(\d{10})-?(\d{2})-?(\d{6})$', '\1-\2-\3') END AS accession FROM r""")
def accession_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, pad = F.col("o_orderkey"), lambda c, n: F.lpad(c.cast("string"), n, "0")
    dash = F.when(k % 4 == 0, "-").otherwise("")
    raw = F.concat(F.when(k % 4 == 3, "x").otherwise(""), pad(F.col("o_custkey"), 10), dash, pad(k % 100, 2), dash, pad(k % 1000000, 6))
    return read(spark, sf_dir, "orders").select("o_orderkey", ids.accession(raw).alias("accession"))


@query("content_digest", "SELECT doc_id, CASE WHEN text IS NOT NULL THEN sha256(text) END AS digest FROM documents")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("filing_lag_days", sql(" SELECT filing_id, date_diff('day', report_date, filing_date) AS lag FROM filings", "filings"))
def filing_lag_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings(spark, sf_dir).select("filing_id", F.datediff("filing_date", "report_date").cast("long").alias("lag"))


@query("log10_combinations", sql(f""", n AS (SELECT sector, count(*)::DOUBLE AS n FROM assets GROUP BY 1)
    SELECT sector, round(list_sum(list_transform(range(1, {K + 1}), lambda i: log10((n - {K} + i) / i))), 8) AS digits FROM n WHERE n >= {K}""", "assets"))
def log10_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many digits the number of K-subsets of each sector has: the number itself never exists."""
    n = assets(spark, sf_dir).groupBy("sector").agg(F.count("*").cast("double").alias("n")).where(F.col("n") >= K)
    terms = F.transform(F.sequence(F.lit(1), F.lit(K)), lambda i: F.log10((F.col("n") - K + i) / i))
    return n.select("sector", R(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), 8).alias("digits"))


@query("subset_codes", "SELECT l_orderkey, bit_or(CAST(1 AS BIGINT) << (l_linenumber - 1)) AS code, count(DISTINCT l_linenumber) AS size FROM lineitem GROUP BY 1")
def subset_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's line numbers as one integer code."""
    bit = F.expr("shiftleft(1L, CAST(l_linenumber - 1 AS INT))")
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bit_or(bit).alias("code"), F.count_distinct("l_linenumber").alias("size"))


@query("null_key_panel", """
    SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority, o_orderstatus AS status, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey % 3 END AS class, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2, 3""")
def null_key_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are null make groups of their own."""
    o = read(spark, sf_dir, "orders")
    keys = (F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("priority"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey") % 3).alias("class"))
    return o.groupBy(*keys).agg(F.count("*").alias("n"), R(F.sum("o_totalprice"), 2).alias("total"))


@query("identifier_scheme_pivot", """
    WITH i AS (SELECT c_custkey AS id, 'cusip' AS scheme, c_mktsegment AS value FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'isin', c_name FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'lei', CAST(c_nationkey AS VARCHAR) FROM customer)
    SELECT id, max(CASE WHEN scheme = 'cusip' THEN value END) AS cusip, max(CASE WHEN scheme = 'isin' THEN value END) AS isin, max(CASE WHEN scheme = 'lei' THEN value END) AS lei FROM i GROUP BY 1""")
def identifier_scheme_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    long = c.select(F.col("c_custkey").alias("id"), F.inline(F.array(
        F.struct(F.lit("cusip").alias("scheme"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("value")),
        F.struct(F.lit("isin").alias("scheme"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("value")),
        F.struct(F.lit("lei").alias("scheme"), F.col("c_nationkey").cast("string").alias("value")))))
    return long.groupBy("id").agg(*(F.max(F.when(F.col("scheme") == s, F.col("value"))).alias(s) for s in ("cusip", "isin", "lei")))


@query("top_by_weight", sql(" SELECT report_date, asset_id, value, row_number() OVER (PARTITION BY report_date ORDER BY value DESC, asset_id) AS place FROM idx QUALIFY place <= 10", "holdings", "idx"))
def top_by_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("report_date").orderBy(F.col("value").desc(), "asset_id")
    return index_holdings(spark, sf_dir).select("report_date", "asset_id", "value", F.row_number().over(w).cast("long").alias("place")).where("place <= 10")


@query("masked_top_by_group", sql(" SELECT sector, asset_id, carbon FROM assets WHERE esg > 10 QUALIFY row_number() OVER (PARTITION BY sector ORDER BY carbon DESC, asset_id) <= 5", "assets"))
def masked_top_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("sector").orderBy(F.col("carbon").desc(), "asset_id")
    return assets(spark, sf_dir).where("esg > 10").select("sector", "asset_id", "carbon", F.row_number().over(w).alias("place")).where("place <= 5").drop("place")


@query("name_match_fold", """
    WITH n AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ' ' || lower(c_mktsegment) WHEN 1 THEN upper(c_mktsegment) || ' ' ELSE 'none ' || c_mktsegment END AS raw FROM customer), pool AS (SELECT DISTINCT c_mktsegment AS segment FROM customer)
    SELECT c_custkey, segment FROM n LEFT JOIN pool ON lower(trim(raw)) = lower(trim(segment))""")
def name_match_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, seg, k = read(spark, sf_dir, "customer"), F.col("c_mktsegment"), F.col("c_custkey") % 3
    raw = F.when(k == 0, F.concat(F.lit(" "), F.lower(seg))).when(k == 1, F.concat(F.upper(seg), F.lit(" "))).otherwise(F.concat(F.lit("none "), seg))
    fold = lambda x: F.lower(F.trim(x))
    pool = c.select(seg.alias("segment")).distinct().withColumn("key", fold(F.col("segment")))
    return c.select("c_custkey", fold(raw).alias("key")).join(pool, "key", "left").select("c_custkey", "segment")


@query("snapshot_dates", sql(" SELECT DISTINCT fund_id, report_date FROM holdings", "holdings"))
def snapshot_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdings(spark, sf_dir).select("fund_id", "report_date").distinct()


@query("monthly_unpivot", sql(""", m AS (SELECT filing_id, report_date, CASE WHEN filing_id % 5 <> 0 THEN amount END AS m1, CASE WHEN filing_id % 3 <> 0 THEN amount / 2 END AS m2, amount / 4 AS m3 FROM filings)
    SELECT filing_id, 1 AS month, last_day(report_date - INTERVAL 2 MONTH) AS month_end, round(m1, 4) AS flow FROM m UNION ALL SELECT filing_id, 2, last_day(report_date - INTERVAL 1 MONTH), round(m2, 4) FROM m UNION ALL SELECT filing_id, 3, report_date, round(m3, 4) FROM m""", "filings"))
def monthly_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rows a report, null where the filing is silent."""
    f, k = filings(spark, sf_dir), F.col("filing_id")
    rows = [(1, F.when(k % 5 != 0, F.col("amount"))), (2, F.when(k % 3 != 0, F.col("amount") / 2)), (3, F.col("amount") / 4)]
    made = F.array(*(F.struct(F.lit(m).alias("month"), F.last_day(F.add_months("report_date", m - 3)).alias("month_end"), R(v, 4).alias("flow")) for m, v in rows))
    return f.select("filing_id", F.inline(made))


RULES_SQL = """WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'x' END AS target, CASE WHEN o_orderstatus = 'F' AND o_custkey % 10 <> 0 THEN 'soft' ELSE 'hard' END AS kind,
        CASE WHEN o_orderkey % 13 = 0 THEN 'rejected' WHEN o_custkey % 4 = 0 THEN 'approved' ELSE 'draft' END AS review FROM orders)"""


@query("mandate_selection", RULES_SQL + """, r AS (SELECT id, CASE WHEN target IS NULL THEN 'no numeric form' WHEN review = 'rejected' THEN 'rejected in review' WHEN kind = 'soft' THEN 'soft wording' WHEN review <> 'approved' THEN 'not approved' END AS reason FROM c)
    SELECT coalesce(reason, 'enforced') AS outcome, count(*) AS n, min(id) AS first_id FROM r GROUP BY 1""")
def mandate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules reviewed (approved by id, soft ones promoted by id), then those enforced and why the others are not."""
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 11 != 0, "x").alias("target"), F.when(F.col("o_orderstatus") == "F", "soft").otherwise("hard").alias("kind"), F.when(k % 13 == 0, "rejected").otherwise("draft").alias("review"), "o_custkey")
    reviewed = words.approve(o, approved=F.col("o_custkey") % 4 == 0, promoted=F.col("o_custkey") % 10 == 0)
    reason = words.not_enforced(F.col("target"), F.lit("disclosed"), F.lit("direct"), F.col("kind"), F.col("review"))
    return reviewed.withColumn("outcome", F.coalesce(reason, F.lit("enforced"))).groupBy("outcome").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


SEED, DRAWS = 20260101, 25


@query("fund_percentile_history", sql(f""", d AS (SELECT report_date, lead(report_date) OVER (ORDER BY report_date) AS nxt FROM (SELECT DISTINCT report_date FROM idx)),
    r AS (SELECT a.report_date AS start, a.asset_id, (b.value / b.balance) / (a.value / a.balance) - 1 AS ret FROM idx a JOIN d USING (report_date) JOIN idx b ON b.report_date = d.nxt AND b.asset_id = a.asset_id),
    f AS (SELECT fund_id, h.report_date AS start, count(*) AS k, sum(value * ret) / sum(value) AS fund_ret FROM holdings h JOIN r ON r.start = h.report_date AND r.asset_id = h.asset_id GROUP BY 1, 2),
    o AS (SELECT start, sample_id, ret, row_number() OVER (PARTITION BY start, sample_id ORDER BY md5(concat_ws('|', '{SEED}', sample_id, start, asset_id)), asset_id) AS k FROM r CROSS JOIN (SELECT unnest(range(0, {DRAWS})) AS sample_id)),
    n AS (SELECT start, sample_id, k, avg(ret) OVER (PARTITION BY start, sample_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS ret FROM o)
    SELECT fund_id, start, k, round(fund_ret, 6) AS fund_return, round(100 * avg(CASE WHEN round(ret, 12) = round(fund_ret, 12) THEN 0.5 WHEN ret < fund_ret THEN 1 ELSE 0 END), 4) AS percentile FROM f JOIN n USING (start, k) GROUP BY ALL""", "holdings", "idx"))
def fund_percentile_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fund in every period among random portfolios of as many names: one grouped query over all periods.

    Line items are shuffled once, by asset: the parent index at a holding's date and
    the next is a sum over the asset's holdings there. Of the random orders only the
    first names are sorted, as many as the period's largest fund has.
    """
    dates = report_dates(spark, sf_dir)
    dates = dates.select("report_date", F.row_number().over(Window.orderBy("report_date")).alias("no"))  # a row a quarter
    h = holdings(spark, sf_dir, dealt="l_partkey").where("asset_id IS NOT NULL").join(F.broadcast(dates), "report_date")  # a row a quarter
    along = Window.partitionBy("asset_id").orderBy("no")
    at = {c: along.rangeBetween(c, c) for c in (0, 1)}
    total = {f"{c}{k}": R(F.sum(c).over(w), 2) for c in ("balance", "value") for k, w in at.items()}
    h = h.withColumn("place", F.row_number().over(along)).withColumns({**total, "met": F.count("*").over(at[1]), "first": F.col("place") == F.min("place").over(at[0])})
    gross = (F.col("value1") / F.col("balance1")) / (F.col("value0") / F.col("balance0"))
    h = cut(h.where("met > 0").select("fund_id", F.col("report_date").alias("start"), "asset_id", "value", (gross - 1).alias("ret"), "first"))
    f = cut(h.groupBy("fund_id", "start").agg(F.count("*").alias("k"), (F.sum(F.col("value") * F.col("ret")) / F.sum("value")).alias("fund_ret")))
    most = f.groupBy("start").agg(F.max("k").alias("k"))
    drawn = sampling.first_draws_by(h.where("first").select("start", "asset_id", "ret"), most, ["start"], DRAWS, SEED)
    order = Window.partitionBy("start", "sample_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    null = drawn.select("start", F.col("rank").cast("long").alias("k"), F.avg("ret").over(order).alias("ret"))
    null = null.groupBy("start", "k").agg(F.collect_list(F.struct(R("ret", 12).alias("ret"))).alias("rets"))  # DRAWS of each
    rank = sampling.mid_rank_of(F.col("rets"), R("fund_ret", 12))
    return f.join(null, ["start", "k"]).select("fund_id", "start", "k", R("fund_ret", 6).alias("fund_return"), R(rank, 4).alias("percentile"))


TAU, MARKET_VARIANCE = 0.05, 0.04


@query("benchmark_tilt_ess", sql(SAMPLES_SQL + f""", b AS (SELECT asset_id, bench / sum(bench) OVER ()::DOUBLE AS b, 0.5 + (asset_id % 11) / 10.0::DOUBLE AS beta, variance AS resid FROM small),
    w AS (SELECT sum(b * beta) AS beta, sum(b * b * resid) AS own FROM b), t AS (SELECT sample_id, avg(b.beta) AS beta, sum(b.resid * ((1.0::DOUBLE / {K} - b.b) ** 2 - b.b ** 2)) AS own FROM s JOIN b USING (asset_id) GROUP BY 1),
    l AS (SELECT sample_id, -(({MARKET_VARIANCE} * (t.beta - w.beta) ** 2 + t.own + w.own)) / (2 * {TAU} * {TAU}) AS lw FROM t, w), e AS (SELECT exp(lw - max(lw) OVER ()) AS x FROM l)
    SELECT count(*) AS n, round(sum(x) * sum(x) / sum(x * x), 6) AS ess FROM e""", "assets"))
def benchmark_tilt_ess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples reweighted by exp(-TE^2 / 2 tau^2) against the benchmark, and their effective number."""
    u = universe_assets(spark, sf_dir)
    total = u.agg(F.sum("bench").cast("double").alias("total"))
    with_share = lambda df: df.crossJoin(F.broadcast(total)).withColumns({"b": F.col("bench") / F.col("total"), "beta": 0.5 + (F.col("asset_id") % 11) / F.lit(10.0)})  # noqa: E731  one row
    b, resid = F.col("b"), F.col("variance")
    whole = with_share(u).agg(F.sum(b * F.col("beta")).alias("bench_beta"), F.sum(b * b * resid).alias("bench_own"))
    t = with_share(samples(spark, sf_dir)).groupBy("sample_id").agg(F.avg("beta").alias("beta"), F.sum(resid * ((1.0 / K - b) * (1.0 / K - b) - b * b)).alias("own"))
    active = F.col("beta") - F.col("bench_beta")
    lw = -(MARKET_VARIANCE * active * active + F.col("own") + F.col("bench_own")) / (2 * TAU * TAU)
    lw = t.crossJoin(F.broadcast(whole)).select(lw.alias("lw"))  # one row
    top = lw.agg(F.max("lw").alias("top"))
    x = F.exp(F.col("lw") - F.col("top"))
    return lw.crossJoin(F.broadcast(top)).agg(F.count("*").alias("n"), R(F.sum(x) * F.sum(x) / F.sum(x * x), 6).alias("ess"))


@query("coverage_and_cost", sql(SAMPLES_SQL + f""", g AS (SELECT sample_id, count(DISTINCT sector) >= 4 AS ok FROM s GROUP BY 1)
    SELECT round(count(DISTINCT s.asset_id) FILTER (ok) / (SELECT count(*) FROM small)::DOUBLE, 8) AS coverage, CASE WHEN count(*) FILTER (ok) > 0 THEN round(count(DISTINCT sample_id)::DOUBLE / count(DISTINCT sample_id) FILTER (ok), 8) END AS draws_a_feasible FROM s JOIN g USING (sample_id)""", "assets"))
def coverage_and_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the assets that accepted samples hold, and draws for each accepted sample."""
    s = samples(spark, sf_dir)
    ok = s.groupBy("sample_id").agg((F.count_distinct("sector") >= 4).alias("ok"))
    n = universe_assets(spark, sf_dir).agg(F.count("*").cast("double").alias("n_assets"))
    a = s.join(ok, "sample_id").agg(F.count_distinct(F.when(F.col("ok"), F.col("asset_id"))).alias("seen"), F.count_distinct("sample_id").alias("drawn"), F.count_distinct(F.when(F.col("ok"), F.col("sample_id"))).alias("kept"))
    return a.crossJoin(F.broadcast(n)).select(R(F.col("seen") / F.col("n_assets"), 8).alias("coverage"), F.when(F.col("kept") > 0, R(F.col("drawn") / F.col("kept"), 8)).alias("draws_a_feasible"))  # one row each


@query("number_appears", None)
def number_appears(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("boolean")
    def there(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: numbers.number_appears(0.8, t))

    return clauses(spark, sf_dir).select("o_orderkey", there("text").alias("holds_080"))


@query("heading_section", None)
def heading_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs under headings that match a pattern."""
    return documents.section(documents.html_paragraphs(read(spark, sf_dir, "pages")), r"(?i)[a-m]")


_LUHN = lambda digits: f"CAST((10 - list_sum(list_transform(range(1, len({digits}) + 1), lambda i: (CAST(substr(reverse({digits}), i, 1) AS INT) * (1 + i % 2)) // 10 + (CAST(substr(reverse({digits}), i, 1) AS INT) * (1 + i % 2)) % 10)) % 10) % 10 AS VARCHAR)"


@query("cusip_isin_conversion", f"""WITH b AS (SELECT p_partkey AS id, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS body FROM part),
    c AS (SELECT id, body || CAST((10 - list_sum(list_transform(range(1, 9), lambda i: (CAST(substr(body, i, 1) AS INT) * (2 - i % 2)) // 10 + (CAST(substr(body, i, 1) AS INT) * (2 - i % 2)) % 10)) % 10) % 10 AS VARCHAR) AS cusip FROM b),
    d AS (SELECT *, CASE WHEN id % 5 = 0 THEN 'DE' ELSE 'US' END AS country, CASE WHEN id % 5 = 0 THEN '1314' ELSE '3028' END || cusip AS digits FROM c)
    SELECT id, cusip, CASE WHEN real THEN country || cusip || {_LUHN("digits")} END AS isin, real AS valid, CASE WHEN real AND country = 'US' THEN cusip END AS back FROM (SELECT *, cusip <> '000000000' AS real FROM d)""")
def cusip_isin_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.lpad(F.col("p_partkey").cast("string"), 8, "0")
    cusip = F.concat(body, ids.cusip_digit(body).cast("string"))
    a = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), cusip.alias("cusip"))
    a = a.withColumn("isin", ids.cusip_to_isin(F.col("cusip"), F.when(F.col("id") % 5 == 0, "DE").otherwise("US")))
    return a.withColumns({"valid": ids.isin_valid(F.col("isin")), "back": ids.isin_to_cusip(F.col("isin"))})
