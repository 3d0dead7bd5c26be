"""The domain's long tables built on the driver's star schema.

funds are suppliers, assets are parts, a holding is what a fund's line items of
one quarter add up to, and filings are orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quarter_end(ts: Column) -> Column:
    """The last day of a timestamp's calendar quarter."""
    return F.last_day(F.add_months(F.trunc(ts.cast("date"), "quarter"), 2))


def report_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report_date): the quarters that hold line items, without adding anything up."""
    return read(spark, sf_dir, "lineitem").select(quarter_end(F.col("l_shipdate")).alias("report_date")).distinct()


def holdings(spark: SparkSession, sf_dir: str, dates: DataFrame | None = None, dealt: str | None = None) -> DataFrame:
    """(fund_id, report_date, asset_id, balance, value): one row a holding; with ``dates`` only theirs, cut before the shuffle.

    Line items are dealt by ``dealt`` (l_partkey: an asset's holdings meet in one task), by the holding if None.
    """
    items = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", quarter_end(F.col("l_shipdate")).alias("report_date"), "l_quantity", "l_extendedprice")
    if dates is not None:
        items = items.join(F.broadcast(dates.select("report_date")), "report_date", "left_semi")  # a row a quarter
    if dealt is not None:
        items = items.repartition(dealt)
    return items.groupBy(F.col("l_suppkey").alias("fund_id"), "report_date", F.col("l_partkey").alias("asset_id")).agg(F.round(F.sum("l_quantity"), 2).alias("balance"), F.round(F.sum("l_extendedprice"), 2).alias("value"))


def index_holdings(spark: SparkSession, sf_dir: str, dates: DataFrame | None = None) -> DataFrame:
    """(report_date, asset_id, balance, value): all funds together, the parent index."""
    return holdings(spark, sf_dir, dates).groupBy("report_date", "asset_id").agg(F.round(F.sum("balance"), 2).alias("balance"), F.round(F.sum("value"), 2).alias("value"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, name, sector, country, esg, carbon)."""
    part = read(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("asset_id"), F.col("p_name").alias("name"), F.col("p_type").alias("sector"), F.col("p_brand").alias("country"),
        F.col("p_size").cast("double").alias("esg"), F.col("p_retailprice").alias("carbon"),
    )


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(filing_id, cik, form, report_date, filing_date): orders as filings; status P is an amendment."""
    o = read(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    form = F.when(F.col("o_orderstatus") == "P", "NPORT-P/A").otherwise("NPORT-P")
    return o.select(F.col("o_orderkey").alias("filing_id"), F.col("o_custkey").alias("cik"), form.alias("form"), quarter_end(F.col("o_orderdate")).alias("report_date"), day.alias("filing_date"), F.col("o_totalprice").alias("amount"))


#: The same views for the DuckDB twins of the queries, as common table expressions.
SQL = {
    "holdings": """holdings AS (
        SELECT l_suppkey AS fund_id, last_day(CAST(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH AS DATE)) AS report_date, l_partkey AS asset_id,
               round(sum(l_quantity), 2) AS balance, round(sum(l_extendedprice), 2) AS value
        FROM lineitem GROUP BY 1, 2, 3)""",
    "idx": """idx AS (
        SELECT report_date, asset_id, round(sum(balance), 2) AS balance, round(sum(value), 2) AS value FROM holdings GROUP BY 1, 2)""",
    "assets": """assets AS (
        SELECT p_partkey AS asset_id, p_name AS name, p_type AS sector, p_brand AS country, CAST(p_size AS DOUBLE) AS esg, p_retailprice AS carbon FROM part)""",
    "filings": """filings AS (
        SELECT o_orderkey AS filing_id, o_custkey AS cik, CASE WHEN o_orderstatus = 'P' THEN 'NPORT-P/A' ELSE 'NPORT-P' END AS form,
               last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS report_date, CAST(o_orderdate AS DATE) AS filing_date, o_totalprice AS amount
        FROM orders)""",
}


def sql(query: str, *views: str) -> str:
    """query after the named views; it may begin with further ``name AS (...)`` and a comma-less SELECT."""
    return "WITH " + ", ".join(SQL[v] for v in views) + query
