"""Queries that write customers' line items as fund report documents and read its parts back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemark.plans.registry import query
from rulemark.sources import reports
from rulemark.sources.tables import quarter_end, read


ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, xml): a customer's line items are the positions of one report; odd line numbers have no title."""
    n = F.col("l_linenumber")
    fields = {"name": F.concat(F.lit("R&D <"), F.col("l_returnflag"), F.lit(">")), "title": F.when(n % 2 == 0, F.col("l_linestatus")), "cusip": F.lpad(F.col("l_partkey").cast("string"), 9, "0"), "balance": F.col("l_quantity"), "units": F.lit("NS"), "curCd": F.lit("USD"), "valUSD": F.col("l_extendedprice"), "payoffProfile": F.lit("Long"), "assetCat": F.lit("EC"), "isRestrictedSec": F.when(n % 3 == 0, "Y").otherwise("N")}
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), quarter_end(F.col("o_orderdate")).alias("date"))
    # A position's text is made once its line has met its order, so that it is moved once.
    items = read(spark, sf_dir, "lineitem").select(*ORDER).join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("c_custkey", "date", *ORDER, reports.position_xml(fields).alias("x"))
    positions = items.groupBy("c_custkey").agg(F.max("date").alias("date"), F.sort_array(F.collect_list(F.struct(*ORDER, "x"))).alias("p"))  # one report's positions
    c, k, worth = read(spark, sf_dir, "customer").join(positions, "c_custkey"), F.col("c_custkey"), F.col("c_acctbal")
    general = {"regName": F.col("c_name"), "regCik": k, "seriesName": F.when(k % 4 == 0, "N/A").otherwise(F.concat(F.lit("S "), F.col("c_mktsegment"))), "repPdEnd": F.date_trunc("year", "date").cast("date"), "repPdDate": F.col("date"), "isFinalFiling": F.when(k % 10 == 0, "Y").otherwise("N")}
    flow = {"sales": F.when(k % 5 != 0, worth), "redemption": worth / 4}
    xml = reports.report_xml(general, {"totAssets": worth * 2, "netAssets": F.when(k % 7 != 0, worth)}, [flow, {}, flow], F.col("p.x"))
    return c.select("c_custkey", xml.alias("xml"))


def parsed(spark: SparkSession, sf_dir: str, positions: bool) -> DataFrame:
    return reports.reports(documents(spark, sf_dir), positions=positions)


REPORTS_SQL = """WITH r AS (SELECT c.*, date FROM customer c JOIN (SELECT o_custkey, max(last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE))) AS date FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) ON o_custkey = c_custkey)"""


@query("report_header", REPORTS_SQL + """ SELECT c_custkey, date AS report_date, c_name AS registrant_name, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS registrant_cik, CASE WHEN c_custkey % 4 <> 0 THEN 'S ' || c_mktsegment END AS series_name,
    CAST(date_trunc('year', date) AS DATE) AS fiscal_year_end, c_custkey % 10 = 0 AS is_final_filing, c_acctbal * 2 AS total_assets, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS net_assets FROM r""")
def report_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.header(parsed(spark, sf_dir, positions=False)).select("c_custkey", "report_date", "registrant_name", "registrant_cik", "series_name", "fiscal_year_end", "is_final_filing", "total_assets", "net_assets")


@query("report_flows", REPORTS_SQL + """ SELECT c_custkey, date AS report_date, month, last_day(date - to_months(3 - month)) AS month_end, CASE WHEN month <> 2 AND c_custkey % 5 <> 0 THEN c_acctbal END AS sales,
    CAST(NULL AS DOUBLE) AS reinvestment, CASE WHEN month <> 2 THEN c_acctbal / 4 END AS redemption FROM r CROSS JOIN (SELECT CAST(unnest([1, 2, 3]) AS INT) AS month)""")
def report_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rows a report, whatever it says."""
    return reports.flows(parsed(spark, sf_dir, positions=False))


@query("report_positions", f"""SELECT o_custkey AS c_custkey, 'invstOrSecs/invstOrSec[' || row_number() OVER (PARTITION BY o_custkey ORDER BY {', '.join(ORDER)}) || ']' AS locator, 'R&D <' || l_returnflag || '>' AS issuer_name, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus END AS title,
    lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS cusip, l_quantity AS balance, l_extendedprice AS value_usd, l_linenumber % 3 = 0 AS is_restricted FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey""")
def report_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_holdings(parsed(spark, sf_dir, positions=True)).select("c_custkey", "locator", "issuer_name", "title", "cusip", "balance", "value_usd", "is_restricted")


@query("series_listing", """SELECT o_custkey, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '-25-' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS accession,
    CASE WHEN o_orderstatus = 'P' THEN 'NPORT-P/A' ELSE 'NPORT-P' END AS form, CAST(o_orderdate AS DATE) AS filing_date, o_orderstatus = 'P' AS is_amendment FROM orders""")
def series_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as an Atom listing of filings, read back."""
    number = F.concat(F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit("25"), F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0"))
    form = F.when(F.col("o_orderstatus") == "P", "NPORT-P/A").otherwise("NPORT-P")
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    entry = tag("entry", tag("content", F.concat(tag("accession-number", number), tag("filing-type", form), tag("filing-date", F.col("o_orderdate").cast("date").cast("string")))))
    lists = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(entry).alias("e"))  # one series' filings
    feed = tag("feed", F.concat(tag("company-info", tag("cik", F.col("o_custkey").cast("string"))), F.array_join("e", "")))
    return reports.series_filings(lists.select("o_custkey", feed.alias("xml"))).select("o_custkey", "cik", "accession", "form", "filing_date", "is_amendment")
