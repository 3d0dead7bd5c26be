"""Queries on filings, their store, provenance and quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemark.operators import ordering, quality, store
from rulemark.operators.cuts import cut, spread
from rulemark.plans.registry import query
from rulemark.sources import readers
from rulemark.sources.tables import filings, holdings, read, sql

R = F.round


@query("submissions_zip_explode", """SELECT o_custkey AS cik, o_orderkey AS accession, strftime(o_orderdate, '%Y-%m-%d') AS filing_date, o_orderstatus AS form FROM orders""")
def submissions_zip_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of parallel JSON arrays per registrant, zipped back to a row a filing."""
    o = read(spark, sf_dir, "orders").select("o_custkey", F.struct(F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderstatus").alias("f"))
    f = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list("f")).alias("f"))
    body = F.to_json(F.struct(F.col("f.o_orderkey").alias("accessionNumber"), F.col("f.day").alias("filingDate"), F.col("f.o_orderstatus").alias("form")))
    return readers.submissions(f.select(F.col("o_custkey").alias("cik"), body.alias("json"))).select("cik", F.col("accession").cast("long").alias("accession"), "filing_date", "form")


@query("fund_tickers_fields", """SELECT n_nationkey AS cik, n_name AS symbol, n_regionkey AS series FROM nation""")
def fund_tickers_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``{fields, data}`` tables, their column order read from the file."""
    n = read(spark, sf_dir, "nation").select(F.array(F.col("n_name"), F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")).alias("row"))
    one = n.agg(F.to_json(F.struct(F.array(F.lit("symbol"), F.lit("series"), F.lit("cik")).alias("fields"), F.array_sort(F.collect_list("row")).alias("data"))).alias("json"))
    out = readers.positional_table(one, ["cik", "symbol", "series"])
    return out.select(F.col("cik").cast("int").alias("cik"), "symbol", F.col("series").cast("int").alias("series"))


UPSERT_SQL = """WITH old AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS amount, c_mktsegment AS segment FROM customer WHERE c_custkey % 5 <> 0),
new AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'N' || c_custkey END AS name, c_acctbal + 1 AS amount, 'FROZEN' AS segment FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(new.id, old.id) AS id, coalesce(new.name, old.name) AS name, round(coalesce(new.amount, old.amount), 2) AS amount, coalesce(old.segment, new.segment) AS segment FROM old FULL JOIN new ON old.id = new.id"""


@query("upsert_non_null", UPSERT_SQL)
def upsert_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    old = c.where(k % 5 != 0).select(k.alias("id"), F.col("c_name").alias("name"), F.when(k % 3 != 0, F.col("c_acctbal")).alias("amount"), F.col("c_mktsegment").alias("segment"))
    new = c.where(k % 2 == 0).select(k.alias("id"), F.when(k % 4 == 0, F.concat(F.lit("N"), k.cast("string"))).alias("name"), (F.col("c_acctbal") + 1).alias("amount"), F.lit("FROZEN").alias("segment"))
    return store.upsert(old, new, ["id"], frozen=["segment"]).select("id", "name", R("amount", 2).alias("amount"), "segment")


PROVENANCE_SQL = """, f AS (SELECT h.fund_id, h.report_date, h.asset_id, fl.filing_id, c.c_custkey AS document_id FROM holdings h
    LEFT JOIN (SELECT cik, report_date, max(filing_id) AS filing_id FROM filings GROUP BY 1, 2) fl ON fl.cik = h.fund_id AND fl.report_date = h.report_date LEFT JOIN customer c ON c.c_custkey = fl.cik AND c.c_acctbal > 0)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = filings(spark, sf_dir).groupBy(F.col("cik").alias("fund_id"), "report_date").agg(F.max("filing_id").alias("filing_id"), F.first("cik").alias("cik"))
    documents = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("cik"), F.col("c_custkey").alias("document_id"))
    return store.provenance(holdings(spark, sf_dir), [(last, ["fund_id", "report_date"]), (documents, ["cik"])]).select("fund_id", "report_date", "asset_id", "filing_id", "document_id")


@query("provenance_view", sql(PROVENANCE_SQL + " SELECT * FROM f", "holdings", "filings"))
def provenance_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir)


@query("provenance_check", sql(PROVENANCE_SQL + " SELECT count(*) AS n_rows, count(*) FILTER (filing_id IS NULL) AS no_filing, count(*) FILTER (document_id IS NULL) AS no_document FROM f", "holdings", "filings"))
def provenance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).agg(F.count("*").alias("n_rows"), F.count_if(F.col("filing_id").isNull()).alias("no_filing"), F.count_if(F.col("document_id").isNull()).alias("no_document"))


@query("source_summary", """
    SELECT s_suppkey AS fund_id, count(DISTINCT l_orderkey) AS n_filings, count(DISTINCT l_partkey) AS n_assets, count(DISTINCT l_returnflag) AS n_flags, count(DISTINCT CAST(l_shipdate AS DATE)) AS n_dates,
        count(l_orderkey) AS n_rows, count(*) FILTER (l_discount = 0) AS n_no_discount FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity > 10 GROUP BY 1""")
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per fund, coverage counts; the condition on rows stays in the join, so empty funds remain."""
    items = read(spark, sf_dir, "lineitem").where("l_quantity > 10").withColumn("day", F.col("l_shipdate").cast("date"))
    j = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("fund_id")).join(items, F.col("fund_id") == F.col("l_suppkey"), "left")
    n = F.countDistinct
    return j.groupBy("fund_id").agg(n("l_orderkey").alias("n_filings"), n("l_partkey").alias("n_assets"), n("l_returnflag").alias("n_flags"), n("day").alias("n_dates"), F.count("l_orderkey").alias("n_rows"), F.count_if(F.col("l_discount") == 0).alias("n_no_discount"))


@query("quality_checks", """
    SELECT 'order key present' AS name, 'error' AS severity, count(*) FILTER (l_orderkey IS NULL) = 0 AS passed, count(*) FILTER (l_orderkey IS NULL) AS n_failed FROM lineitem
    UNION ALL SELECT 'quantity positive', 'error', count(*) FILTER (NOT l_quantity > 0) = 0, count(*) FILTER (NOT l_quantity > 0) FROM lineitem
    UNION ALL SELECT 'discount below 5%', 'warning', count(*) FILTER (NOT l_discount < 0.05) = 0, count(*) FILTER (NOT l_discount < 0.05) FROM lineitem
    UNION ALL SELECT 'line unique', 'error', count(*) = 0, count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)""")
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"order key present": ("error", F.col("l_orderkey").isNotNull()), "quantity positive": ("error", F.col("l_quantity") > 0), "discount below 5%": ("warning", F.col("l_discount") < 0.05)}
    rows = read(spark, sf_dir, "lineitem")
    return quality.check(rows, checks).unionByName(quality.unique(rows, ["l_orderkey", "l_linenumber"], "line unique"))


BANDS_SQL = "CASE WHEN d IS NULL THEN 'missing' WHEN d <= 0.01 THEN 'within 1%' WHEN d <= 0.10 THEN '1-10%' ELSE 'over 10%' END"


@query("crosscheck_bands", sql(f""", x AS (SELECT h.asset_id, abs(h.value / h.balance / p.p_retailprice / 1.02 - 1) AS d FROM holdings h LEFT JOIN part p ON p.p_partkey = h.asset_id AND p.p_size > 5)
    SELECT {BANDS_SQL} AS band, count(*) AS n, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.95), 6) AS p95, round(max(d), 6) AS worst FROM x GROUP BY 1""", "holdings"))
def crosscheck_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("asset_id"), "p_retailprice")
    x = holdings(spark, sf_dir).join(p, "asset_id", "left").withColumn("d", F.abs(F.col("value") / F.col("balance") / F.col("p_retailprice") / 1.02 - 1))
    x = cut(x.select(quality.band(F.col("d")).alias("band"), "d"))
    middle = ordering.quantiles(x, "band", "d", {"median": 0.5, "p95": 0.95})
    total = x.groupBy("band").agg(F.count("*").alias("n"), F.max("d").alias("worst"))
    return total.join(middle.drop("n"), "band", "left").select("band", "n", R("median", 6).alias("median"), R("p95", 6).alias("p95"), R("worst", 6).alias("worst"))


@query("price_crosscheck_asof", sql(""", px AS (SELECT l_partkey AS asset_id, CAST(l_shipdate AS DATE) AS day, max(l_extendedprice / l_quantity) AS close FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
    SELECT i.asset_id, i.report_date, px.day, round(i.value / i.balance / px.close - 1, 6) AS difference FROM idx i ASOF LEFT JOIN px ON i.asset_id = px.asset_id AND i.report_date >= px.day""", "holdings", "idx"))
def price_crosscheck_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulemark.operators import joins
    from rulemark.sources.tables import index_holdings

    px = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("asset_id"), F.col("l_shipdate").cast("date").alias("day")).agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))
    out = joins.as_of(index_holdings(spark, sf_dir), px, ["asset_id"], "report_date", "day", ["close"])
    return out.select("asset_id", "report_date", "day", R(F.col("value") / F.col("balance") / F.col("close") - 1, 6).alias("difference"))


@query("set_operations", """
    WITH a AS (SELECT DISTINCT l_suppkey AS fund, l_partkey AS asset FROM lineitem), b AS (SELECT DISTINCT l_suppkey - 1 AS fund, l_partkey AS asset FROM lineitem)
    SELECT fund, 'both' AS kind, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY 1
    UNION ALL SELECT fund, 'first only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) GROUP BY 1
    UNION ALL SELECT fund, 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY 1""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets that each fund and the next one both hold, that it alone holds, and that either holds."""
    items = read(spark, sf_dir, "lineitem")
    # A row a fund and asset, with whether it and whether the next fund holds it: one pass in place of three set operations.
    of = lambda k: items.select((F.col("l_suppkey") - k).alias("fund"), F.col("l_partkey").alias("asset"), F.lit(k).alias("k"))
    held = spread(of(0).union(of(1)), "fund", "asset").groupBy("fund", "asset").agg((F.min("k") == 0).alias("first"), (F.max("k") == 1).alias("next"))
    n = held.groupBy("fund").agg(F.count_if(F.col("first") & F.col("next")).alias("both"), F.count_if(F.col("first") & ~F.col("next")).alias("first only"), F.count("*").alias("either"))
    return n.unpivot("fund", ["both", "first only", "either"], "kind", "n").where("n > 0")


@query("value_counts_mode", """
    WITH c AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, arg_min(l_linenumber, (-n, l_linenumber)) AS mode, max(n) AS n FROM c GROUP BY 1""")
def value_counts_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("k"))
    return c.groupBy("l_suppkey").agg(F.min_by("l_linenumber", F.struct(-F.col("k"), F.col("l_linenumber"))).alias("mode"), F.max("k").alias("n"))


@query("quarter_ends", """WITH s AS (SELECT date_trunc('quarter', min(l_shipdate)) AS a, date_trunc('quarter', max(l_shipdate)) AS b FROM lineitem), q AS (SELECT unnest(generate_series(a, b, INTERVAL 3 MONTH)) AS d FROM s),
    n AS (SELECT date_trunc('quarter', l_shipdate) AS d, count(*) AS n FROM lineitem GROUP BY 1) SELECT last_day(CAST(q.d + INTERVAL 2 MONTH AS DATE)) AS quarter_end, coalesce(n, 0) AS n FROM q LEFT JOIN n ON n.d = q.d""")
def quarter_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quarter's end from the first to the last shipment, and its line items, none left out where nothing was shipped."""
    items = read(spark, sf_dir, "lineitem").select(F.trunc("l_shipdate", "quarter").alias("d"))
    span = items.agg(F.min("d").alias("a"), F.max("d").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b", F.expr("interval 3 months"))).alias("d"))
    return days.join(items.groupBy("d").agg(F.count("*").alias("n")), "d", "left").select(F.last_day(F.add_months("d", 2)).alias("quarter_end"), F.coalesce("n", F.lit(0)).alias("n"))

