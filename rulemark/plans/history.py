"""Queries on holdings, prices, changes and their history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rulemark.operators import joins, prices
from rulemark.plans.registry import query
from rulemark.sources.tables import assets, filings, holdings, index_holdings, quarter_end, read, sql

R = F.round

PAIRS_SQL = """, dates AS (
    SELECT fund_id, report_date, lead(report_date) OVER (PARTITION BY fund_id ORDER BY report_date) AS next_date
    FROM (SELECT DISTINCT fund_id, report_date FROM holdings)
), pairs AS (
    SELECT a.fund_id, a.report_date AS start, d.next_date AS "end", a.asset_id, a.balance AS b0, a.value AS v0, b.balance AS b1, b.value AS v1
    FROM holdings a JOIN dates d USING (fund_id, report_date) JOIN holdings b ON b.fund_id = a.fund_id AND b.report_date = d.next_date AND b.asset_id = a.asset_id
)"""
INDEX_PAIRS_SQL = """, dates AS (
    SELECT report_date, lead(report_date) OVER (ORDER BY report_date) AS next_date FROM (SELECT DISTINCT report_date FROM idx)
), pairs AS (
    SELECT a.report_date AS start, d.next_date AS "end", a.asset_id, a.balance AS b0, a.value AS v0, b.balance AS b1, b.value AS v1
    FROM idx a JOIN dates d USING (report_date) JOIN idx b ON b.report_date = d.next_date AND b.asset_id = a.asset_id
)"""


def index_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index_holdings(spark, sf_dir).withColumn("idx", F.lit(1))
    return prices.paired(rows, ["idx"]).drop("idx")


@query("equity_sleeve", """
    WITH t AS (SELECT * FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O' AND l_quantity > 0 AND l_extendedprice > 0)
    SELECT l_orderkey, l_linenumber, l_suppkey, round(l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_suppkey), 8) AS weight FROM t""")
def equity_sleeve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").where((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"))
    rows = rows.withColumns({"cat": F.lit("EC"), "payoff": F.lit("Long"), "units": F.lit("NS")})
    out = prices.equity_sleeve(rows, "cat", "payoff", "units", "l_quantity", "l_extendedprice", ["l_suppkey"])
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", R("weight", 8).alias("weight"))


@query("keyed_sleeve_weights", sql("""
    SELECT fund_id, report_date, asset_id, balance, value, round(value / sum(value) OVER (PARTITION BY fund_id, report_date), 8) AS weight FROM holdings""", "holdings"))
def keyed_sleeve_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("fund_id", "report_date")
    return holdings(spark, sf_dir).withColumn("weight", R(F.col("value") / F.sum("value").over(w), 8))


@query("implied_price_panel", sql("""
    SELECT report_date, asset_id, value / balance AS price, balance AS shares FROM idx WHERE balance > 0 AND value > 0""", "holdings", "idx"))
def implied_price_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_holdings(spark, sf_dir).where("balance > 0 AND value > 0").select("report_date", "asset_id", (F.col("value") / F.col("balance")).alias("price"), F.col("balance").alias("shares"))


@query("wide_price_pivot", sql("""
    SELECT asset_id, CAST(year(report_date) AS INT) AS year, max(value / balance) FILTER (quarter(report_date) = 1) AS q1, max(value / balance) FILTER (quarter(report_date) = 2) AS q2,
           max(value / balance) FILTER (quarter(report_date) = 3) AS q3, max(value / balance) FILTER (quarter(report_date) = 4) AS q4 FROM idx GROUP BY 1, 2""", "holdings", "idx"))
def wide_price_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implied prices of every asset: a row an asset and year, a column a quarter, since assets grow with the tables and columns may not."""
    p = index_holdings(spark, sf_dir).select("asset_id", F.year("report_date").alias("year"), F.concat(F.lit("q"), F.quarter("report_date")).alias("quarter"), (F.col("value") / F.col("balance")).alias("price"))
    return p.groupBy("asset_id", "year").pivot("quarter", ["q1", "q2", "q3", "q4"]).agg(F.max("price"))


@query("consecutive_returns", sql(PAIRS_SQL + """
    SELECT fund_id, start, "end", asset_id, round((v1 / b1) / (v0 / b0) - 1, 6) AS ret FROM pairs""", "holdings"))
def consecutive_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    gross = (F.col("value1") / F.col("balance1")) / (F.col("value0") / F.col("balance0"))
    return prices.paired(holdings(spark, sf_dir), ["fund_id"]).select("fund_id", "start", "end", "asset_id", R(gross - 1, 6).alias("ret"))


LADDER_SQL = INDEX_PAIRS_SQL + """, f AS (
    SELECT *, b1 / b0 AS raw, (v1 / b1) / (v0 / b0) AS gross, b1 / b0 / quantile_cont(b1 / b0, 0.5) OVER (PARTITION BY start) AS ratio FROM pairs
), r(k, s) AS (VALUES (0, 2.0::DOUBLE), (1, 3), (2, 4), (3, 5), (4, 10), (5, 20), (6, 0.5), (7, 1::DOUBLE / 3), (8, 0.25), (9, 0.2), (10, 0.1), (11, 0.05)),
n AS (
    SELECT start, asset_id, arg_min(s, (round(abs(ln(ratio / s)), 12), k)) AS split FROM f CROSS JOIN r GROUP BY 1, 2
), l AS (
    SELECT f.*, n.split, abs(ratio - 1) <= 0.08 AS steady, abs(ratio / n.split - 1) <= 0.15 AND gross * n.split BETWEEN 0.5 AND 1.6 AS is_split, gross BETWEEN 0.4 AND 2.5 AS plain
    FROM f JOIN n USING (start, asset_id)
)"""


@query("implied_returns_ladder", sql(LADDER_SQL + """
    SELECT start, "end", asset_id,
        round(CASE WHEN steady THEN gross - 1 WHEN is_split THEN gross * split - 1 WHEN plain THEN gross - 1 END, 6) AS ret,
        CASE WHEN steady OR is_split THEN 'derived' WHEN plain THEN 'assumed' ELSE 'unknown' END AS status,
        NOT steady AND is_split AS split_adjusted, NOT steady AND NOT is_split AND plain AS share_count_changed
    FROM l""", "holdings", "idx"))
def implied_returns_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prices.implied_returns(index_pairs(spark, sf_dir), passive_by=["start"])
    return out.select("start", "end", "asset_id", R("ret", 6).alias("ret"), "status", "split_adjusted", "share_count_changed")


@query("chained_returns", sql(PAIRS_SQL + """, own AS (
        SELECT (fund_id + 1) // 2 AS family, start, "end", asset_id, fund_id, CASE WHEN abs(b1 / b0 - 1) <= 0.08 THEN (v1 / b1) / (v0 / b0) - 1 END AS ret FROM pairs
    ), parent AS (SELECT family, start, "end", asset_id, ret FROM own WHERE fund_id % 2 = 1), extra AS (SELECT family, start, "end", asset_id, ret FROM own WHERE fund_id % 2 = 0),
    u AS (SELECT *, 0 AS k FROM parent WHERE ret IS NOT NULL UNION ALL SELECT *, 1 FROM extra WHERE ret IS NOT NULL)
    SELECT family, start, "end", asset_id, round(arg_min(ret, k), 6) AS ret, CAST(min(k) AS INT) AS source_no, round(max(ret) - min(ret), 6) AS disagreement FROM u GROUP BY 1, 2, 3, 4""", "holdings"))
def chained_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prices.implied_returns(prices.paired(holdings(spark, sf_dir), ["fund_id"])).withColumn("family", F.floor((F.col("fund_id") + 1) / 2))
    out = prices.chained([own.where(F.col("fund_id") % 2 == k) for k in (1, 0)], ["family", "start", "end", "asset_id"])
    return out.select("family", "start", "end", "asset_id", R("ret", 6).alias("ret"), "source_no", R("disagreement", 6).alias("disagreement"))


@query("split_adjust_forward", sql(INDEX_PAIRS_SQL + """, p AS (SELECT *, (v1 / b1) / (v0 / b0) AS pr, b1 / b0 AS sr FROM pairs),
    f(x) AS (VALUES (2.0::DOUBLE), (3), (4), (5), (6), (8), (10), (15), (20), (25), (30), (50)),
    hit AS (SELECT start, asset_id, max(x) AS x FROM p JOIN f ON pr * x BETWEEN 0.75 AND 1.30 AND sr >= 0.45 * x + 0.5 GROUP BY 1, 2)
    SELECT start, "end", asset_id, round(pr * coalesce(x, 1), 6) AS price_ratio, x IS NOT NULL AS adjusted FROM p LEFT JOIN hit USING (start, asset_id)""", "holdings", "idx"))
def split_adjust_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = index_pairs(spark, sf_dir).withColumns({"pr": (F.col("value1") / F.col("balance1")) / (F.col("value0") / F.col("balance0")), "sr": F.col("balance1") / F.col("balance0")})
    p = p.withColumn("got", prices.forward_split(F.col("pr"), F.col("sr")))
    return p.select("start", "end", "asset_id", R("got", 6).alias("price_ratio"), (F.col("got") != F.col("pr")).alias("adjusted"))


@query("return_coverage_quality", sql(""", d AS (
        SELECT report_date, lead(report_date) OVER (ORDER BY report_date) AS next_date FROM (SELECT DISTINCT report_date FROM idx)
    ), a AS (SELECT d.report_date AS start, d.next_date AS "end", asset_id FROM idx JOIN d USING (report_date) WHERE d.next_date IS NOT NULL),
    b AS (SELECT d.report_date AS start, d.next_date AS "end", asset_id FROM idx JOIN d ON idx.report_date = d.next_date)
    SELECT coalesce(a.start, b.start) AS start, coalesce(a."end", b."end") AS "end", count(*) FILTER (a.asset_id IS NOT NULL AND b.asset_id IS NOT NULL) AS n_both,
        count(*) FILTER (b.asset_id IS NULL) AS n_start_only, count(*) FILTER (a.asset_id IS NULL) AS n_end_only
    FROM a FULL JOIN b ON a.start = b.start AND a.asset_id = b.asset_id GROUP BY 1, 2""", "holdings", "idx"))
def return_coverage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prices.paired(index_holdings(spark, sf_dir).withColumn("idx", F.lit(1)), ["idx"], how="full")
    return p.groupBy("start", "end").agg(F.count_if(F.col("has0") & F.col("has1")).alias("n_both"), F.count_if(F.col("has1").isNull()).alias("n_start_only"), F.count_if(F.col("has0").isNull()).alias("n_end_only"))


CHANGES_SQL = """, d AS (
    SELECT fund_id, report_date, lead(report_date) OVER (PARTITION BY fund_id ORDER BY report_date) AS next_date FROM (SELECT DISTINCT fund_id, report_date FROM holdings)
), a AS (SELECT h.fund_id, h.report_date AS start, next_date AS "end", asset_id, balance, value FROM holdings h JOIN d USING (fund_id, report_date) WHERE next_date IS NOT NULL),
b AS (SELECT h.fund_id, d.report_date AS start, next_date AS "end", asset_id, balance, value FROM holdings h JOIN d ON d.fund_id = h.fund_id AND d.next_date = h.report_date),
j AS (
    SELECT coalesce(a.fund_id, b.fund_id) AS fund_id, coalesce(a.start, b.start) AS start, coalesce(a."end", b."end") AS "end", coalesce(a.asset_id, b.asset_id) AS asset_id,
        a.asset_id IS NOT NULL AS has0, b.asset_id IS NOT NULL AS has1, coalesce(a.balance, 0) AS b0, coalesce(a.value, 0) AS v0, coalesce(b.balance, 0) AS b1, coalesce(b.value, 0) AS v1
    FROM a FULL JOIN b ON a.fund_id = b.fund_id AND a.start = b.start AND a.asset_id = b.asset_id
), w AS (
    SELECT *, v0 / sum(v0) OVER p AS w0, v1 / sum(v1) OVER p AS w1, CASE WHEN b0 > 0 AND b1 > 0 THEN b1 / b0 END AS sr,
        CASE WHEN b0 > 0 AND b1 > 0 THEN (v1 / b1) / (v0 / b0) END AS pr FROM j WINDOW p AS (PARTITION BY fund_id, start)
), r(k, s) AS (VALUES (0, 1.5::DOUBLE), (1, 2), (2, 3), (3, 4), (4, 5), (5, 10), (6, 20), (7, 0.5), (8, 1::DOUBLE / 3), (9, 0.25), (10, 0.2), (11, 0.1), (12, 0.05)),
n AS (SELECT fund_id, start, asset_id, arg_min(s, (round(abs(sr / s - 1), 12), k)) AS s FROM w CROSS JOIN r WHERE sr IS NOT NULL GROUP BY 1, 2, 3),
f AS (SELECT w.*, CASE WHEN abs(sr / n.s - 1) <= 0.02 AND abs(pr * n.s - 1) <= 0.15 THEN n.s ELSE 1 END AS factor FROM w LEFT JOIN n USING (fund_id, start, asset_id)),
g AS (SELECT *, sr / factor AS adj, pr * factor - 1 AS ret FROM f),
h AS (SELECT *, CASE WHEN w0 = 0 THEN 0 ELSE w0 * (1 + ret) / sum(w0 * (1 + ret)) OVER (PARTITION BY fund_id, start) END AS drift FROM g),
changes AS (SELECT *, w1 - drift AS active, CASE WHEN NOT has0 THEN 'new' WHEN NOT has1 THEN 'exit' WHEN abs(adj - 1) <= 0.005 THEN 'unchanged' WHEN adj > 1 THEN 'increase' ELSE 'decrease' END AS change FROM h)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.holding_changes(prices.paired(holdings(spark, sf_dir), ["fund_id"], how="full"), ["fund_id", "start"])


@query("holding_changes", sql(CHANGES_SQL + """
    SELECT fund_id, start, "end", asset_id, round(w0, 8) AS weight0, round(w1, 8) AS weight1, round(adj, 6) AS share_ratio, round(ret, 6) AS implied_return,
        round(drift, 8) AS drift_weight, round(active, 8) AS active_weight, change FROM changes""", "holdings"))
def holding_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).select(
        "fund_id", "start", "end", "asset_id", R("w0", 8).alias("weight0"), R("w1", 8).alias("weight1"), R("ratio_adj", 6).alias("share_ratio"), R("implied_return", 6).alias("implied_return"),
        R("drift", 8).alias("drift_weight"), R("active_weight", 8).alias("active_weight"), "change",
    )


@query("holding_changes_by_group", sql(CHANGES_SQL.replace("holdings h JOIN", "holdings h JOIN", 1) + """, assets AS (SELECT p_partkey AS asset_id, p_type AS sector FROM part)
    SELECT fund_id, start, sector, round(sum(w0), 6) AS weight0, round(sum(w1), 6) AS weight1, CASE WHEN count(*) = count(active) THEN round(sum(active), 6) END AS active_weight
    FROM changes JOIN assets USING (asset_id) GROUP BY 1, 2, 3""", "holdings"))
def holding_changes_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes(spark, sf_dir).join(assets(spark, sf_dir).select("asset_id", "sector"), "asset_id")
    whole = F.when(F.count("*") == F.count("active_weight"), R(F.sum("active_weight"), 6))
    return rows.groupBy("fund_id", "start", "sector").agg(R(F.sum("w0"), 6).alias("weight0"), R(F.sum("w1"), 6).alias("weight1"), whole.alias("active_weight"))


@query("change_counts_turnover", sql(CHANGES_SQL + """
    SELECT fund_id, start, count(*) FILTER (change = 'new') AS n_new, count(*) FILTER (change = 'exit') AS n_exit, count(*) FILTER (change = 'increase') AS n_increase,
        count(*) FILTER (change = 'decrease') AS n_decrease, count(*) FILTER (change = 'unchanged') AS n_unchanged, round(sum(abs(active)) / 2, 6) AS turnover FROM changes GROUP BY 1, 2""", "holdings"))
def change_counts_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("new", "exit", "increase", "decrease", "unchanged")
    return changes(spark, sf_dir).groupBy("fund_id", "start").agg(*(F.count_if(F.col("change") == k).alias(f"n_{k}") for k in kinds), R(F.sum(F.abs("active_weight")) / 2, 6).alias("turnover"))


@query("nav_period_return", """
    WITH m AS (
        SELECT o_custkey AS class_id, date_trunc('month', o_orderdate)::DATE AS month, (avg(o_totalprice) - 150000) / 1e7 AS r FROM orders GROUP BY 1, 2
    ), q AS (SELECT class_id, last_day((date_trunc('quarter', month) + INTERVAL 2 MONTH)::DATE) AS report_date, count(*) AS n, product(1 + r) - 1 AS ret FROM m GROUP BY 1, 2)
    SELECT class_id, report_date, CAST(n AS BIGINT) AS n_months, CASE WHEN n = 3 THEN round(ret, 8) END AS ret FROM q""")
def nav_period_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")
    m = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("class_id"), month).agg(((F.avg("o_totalprice") - 150000) / 1e7).alias("r"))
    report = F.last_day(F.add_months(F.trunc("month", "quarter"), 2)).alias("report_date")
    q = m.groupBy("class_id", report).agg(F.count("*").alias("n_months"), (F.product(1 + F.col("r")) - 1).alias("ret"))
    return q.withColumn("ret", F.when(F.col("n_months") == 3, R("ret", 8)))


@query("net_flow_ratio", """
    WITH q AS (
        SELECT last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS report_date, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS sales,
            sum(o_totalprice) FILTER (o_orderstatus = 'P') AS reinvestment, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS redemption, sum(o_totalprice) AS net_assets FROM orders GROUP BY 1)
    SELECT report_date, CASE WHEN (sales IS NULL AND redemption IS NULL) OR net_assets <= 0 THEN NULL
        ELSE round((coalesce(sales, 0) + coalesce(reinvestment, 0) - coalesce(redemption, 0)) / net_assets, 8) END AS flow_ratio FROM q""")
def net_flow_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = F.last_day(F.add_months(F.trunc(F.col("o_orderdate").cast("date"), "quarter"), 2)).alias("report_date")
    of = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    q = read(spark, sf_dir, "orders").groupBy(report).agg(of("F").alias("s"), of("P").alias("i"), of("O").alias("r"), F.sum("o_totalprice").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    known = (F.col("s").isNotNull() | F.col("r").isNotNull()) & (F.col("n") > 0)
    return q.select("report_date", F.when(known, R((zero("s") + zero("i") - zero("r")) / F.col("n"), 8)).alias("flow_ratio"))


@query("frozen_return", sql(PAIRS_SQL + """, p AS (SELECT *, (v1 / b1) / (v0 / b0) - 1 AS ret FROM pairs)
    SELECT fund_id, start, "end", count(*) AS n_known, round(sum(v0 * ret) / sum(v0), 6) AS frozen_return FROM p GROUP BY 1, 2, 3""", "holdings"))
def frozen_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prices.paired(holdings(spark, sf_dir), ["fund_id"]).withColumn("ret", (F.col("value1") / F.col("balance1")) / (F.col("value0") / F.col("balance0")) - 1)
    return p.groupBy("fund_id", "start", "end").agg(F.count("*").alias("n_known"), R(F.sum(F.col("value0") * F.col("ret")) / F.sum("value0"), 6).alias("frozen_return"))


@query("period_case_coverage", sql(""", d AS (SELECT report_date, lead(report_date) OVER (ORDER BY report_date) AS next_date FROM (SELECT DISTINCT report_date FROM idx)),
    known AS (SELECT a.report_date, a.asset_id FROM idx a JOIN d USING (report_date) JOIN idx b ON b.report_date = d.next_date AND b.asset_id = a.asset_id)
    SELECT fund_id, report_date, count(*) AS n_held, count(known.asset_id) AS n_known, round(sum(CASE WHEN known.asset_id IS NOT NULL THEN value ELSE 0 END) / sum(value), 6) AS known_weight
    FROM holdings LEFT JOIN known USING (report_date, asset_id) GROUP BY 1, 2""", "holdings", "idx"))
def period_case_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = index_pairs(spark, sf_dir).select(F.col("start").alias("report_date"), "asset_id", F.lit(True).alias("known"))
    rows = holdings(spark, sf_dir).join(known, ["report_date", "asset_id"], "left")
    weight = R(F.sum(F.when(F.col("known"), F.col("value")).otherwise(0.0)) / F.sum("value"), 6)
    return rows.groupBy("fund_id", "report_date").agg(F.count("*").alias("n_held"), F.count("known").alias("n_known"), weight.alias("known_weight"))


@query("benchmark_fill_returns", sql(LADDER_SQL + """, k AS (SELECT start, asset_id, v0, CASE WHEN steady THEN gross - 1 WHEN is_split THEN gross * split - 1 END AS ret FROM l),
    m AS (SELECT start, sum(v0 * ret) / sum(CASE WHEN ret IS NOT NULL THEN v0 END) AS mean FROM k GROUP BY 1)
    SELECT start, asset_id, round(coalesce(ret, mean), 6) AS ret, ret IS NULL AS filled FROM k JOIN m USING (start)""", "holdings", "idx"))
def benchmark_fill_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = prices.implied_returns(index_pairs(spark, sf_dir), passive_by=["start"], plain=False).select("start", "asset_id", "value0", "ret")
    mean = k.groupBy("start").agg((F.sum(F.col("value0") * F.col("ret")) / F.sum(F.when(F.col("ret").isNotNull(), F.col("value0")))).alias("mean"))
    return k.join(mean, "start").select("start", "asset_id", R(F.coalesce("ret", "mean"), 6).alias("ret"), F.col("ret").isNull().alias("filled"))


BETA_SQL = INDEX_PAIRS_SQL + """, r AS (SELECT start, asset_id, v0, (v1 / b1) / (v0 / b0) - 1 AS ret FROM pairs),
m AS (SELECT start, sum(v0 * ret) / sum(v0) AS mkt FROM r GROUP BY 1),
b AS (SELECT asset_id, count(*) AS n, covar_samp(ret, mkt) / var_samp(mkt) AS raw FROM r JOIN m USING (start) GROUP BY 1)"""


@query("single_index_beta", sql(BETA_SQL + """
    SELECT asset_id, n AS n_periods, round(CASE WHEN n >= 3 THEN 0.5 + 0.5 * raw ELSE 1 END, 6) AS beta FROM b""", "holdings", "idx"))
def single_index_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _betas(spark, sf_dir)
    return b.select("asset_id", F.col("n").alias("n_periods"), R("beta", 6).alias("beta"))


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    gross = (F.col("value1") / F.col("balance1")) / (F.col("value0") / F.col("balance0"))
    return index_pairs(spark, sf_dir).select("start", "asset_id", "value0", (gross - 1).alias("ret"))


def _market(r: DataFrame) -> DataFrame:
    return r.groupBy("start").agg((F.sum(F.col("value0") * F.col("ret")) / F.sum("value0")).alias("mkt"))


def _betas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, n, beta, resid): beta shrunk half way to one, residual variance, over all periods."""
    r = _returns(spark, sf_dir)
    j = r.join(F.broadcast(_market(r)), "start")  # one row a period
    b = j.groupBy("asset_id").agg(F.count("*").alias("n"), F.try_divide(F.covar_samp("ret", "mkt"), F.var_samp("mkt")).alias("raw"), F.var_samp("ret").alias("vr"), F.var_samp("mkt").alias("vm"), F.covar_samp("ret", "mkt").alias("cv"))
    beta = F.when(F.col("n") >= 3, 0.5 + 0.5 * F.col("raw")).otherwise(1.0)
    return b.withColumn("beta", beta).withColumn("resid", F.col("vr") - 2 * F.col("beta") * F.col("cv") + F.col("beta") ** 2 * F.col("vm"))


@query("single_index_risk", sql(BETA_SQL + """, x AS (
        SELECT asset_id, count(*) AS n, covar_samp(ret, mkt) AS cv, var_samp(mkt) AS vm, var_samp(ret) AS vr FROM r JOIN m USING (start) GROUP BY 1
    ), bt AS (SELECT *, CASE WHEN n >= 3 THEN 0.5 + 0.5 * cv / vm ELSE 1 END AS beta FROM x),
    rs AS (SELECT *, CASE WHEN n >= 3 THEN greatest(vr - 2 * beta * cv + beta * beta * vm, 1e-12) END AS resid FROM bt),
    md AS (SELECT quantile_cont(resid, 0.5) AS med FROM rs), mv AS (SELECT var_samp(mkt) AS var_m FROM m),
    w AS (SELECT fund_id, report_date, asset_id, value / sum(value) OVER (PARTITION BY fund_id, report_date) AS w FROM holdings)
    SELECT fund_id, report_date, round(sqrt(any_value(var_m) * sum(w * coalesce(beta, 1)) ** 2 + sum(w * w * coalesce(resid, med))), 6) AS risk
    FROM w LEFT JOIN rs USING (asset_id) CROSS JOIN md CROSS JOIN mv GROUP BY 1, 2""", "holdings", "idx"))
def single_index_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _betas(spark, sf_dir).withColumn("resid", F.when(F.col("n") >= 3, F.greatest("resid", F.lit(1e-12))))
    one = b.agg(F.percentile("resid", F.lit(0.5)).alias("med")).crossJoin(_market(_returns(spark, sf_dir)).agg(F.var_samp("mkt").alias("var_m")))
    w = holdings(spark, sf_dir).withColumn("w", F.col("value") / F.sum("value").over(Window.partitionBy("fund_id", "report_date")))
    j = w.join(b.select("asset_id", "beta", "resid"), "asset_id", "left").crossJoin(F.broadcast(one))  # one row
    var = F.first("var_m") * F.pow(F.sum(F.col("w") * F.coalesce("beta", F.lit(1.0))), F.lit(2.0)) + F.sum(F.col("w") * F.col("w") * F.coalesce("resid", "med"))
    return j.groupBy("fund_id", "report_date").agg(R(F.sqrt(var), 6).alias("risk"))


@query("expanding_past_mean", sql(INDEX_PAIRS_SQL + """, r AS (SELECT start, sum(v0 * ((v1 / b1) / (v0 / b0) - 1)) / sum(v0) AS mkt FROM pairs GROUP BY 1)
    SELECT start, round(avg(mkt) OVER w, 6) AS past_mean, count(mkt) OVER w AS n_past FROM r WINDOW w AS (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", "holdings", "idx"))
def expanding_past_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row a period
    return _market(_returns(spark, sf_dir)).select("start", R(F.avg("mkt").over(w), 6).alias("past_mean"), F.count("mkt").over(w).alias("n_past"))


FUND_Q_SQL = PAIRS_SQL + """, fr AS (SELECT fund_id, start, sum(v0 * ((v1 / b1) / (v0 / b0) - 1)) / sum(v0) AS ret FROM pairs GROUP BY 1, 2),
fq AS (SELECT a.fund_id, a.start, any_value(a.ret) AS ret, 100 * avg(CASE WHEN abs(b.ret - a.ret) <= 1e-12 THEN 0.5 WHEN b.ret < a.ret THEN 1 ELSE 0 END) AS pct
    FROM fr a JOIN fr b ON a.start = b.start AND a.fund_id <> b.fund_id GROUP BY 1, 2)"""


def fund_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fund-quarter's return and mid-rank percentile among the other funds' of that quarter."""
    p = prices.paired(holdings(spark, sf_dir), ["fund_id"]).withColumn("ret", (F.col("value1") / F.col("balance1")) / (F.col("value0") / F.col("balance0")) - 1)
    fr = p.groupBy("fund_id", "start").agg((F.sum(F.col("value0") * F.col("ret")) / F.sum("value0")).alias("ret"))
    # Ranks from one sort a quarter: rows strictly below, and ties other than the row itself.
    over = "count(*) OVER (PARTITION BY start ORDER BY ret RANGE BETWEEN {} AND 1e-12D FOLLOWING)"
    near = F.expr(over.format("1e-12D PRECEDING"))
    below = F.expr(over.format("UNBOUNDED PRECEDING")) - near
    n = F.count("*").over(Window.partitionBy("start"))
    return fr.withColumn("pct", F.when(n > 1, 100.0 * (below + 0.5 * (near - 1)) / (n - 1))).where(F.col("pct").isNotNull())


@query("skill_fund_quarter", sql(FUND_Q_SQL + " SELECT fund_id, start, round(ret, 6) AS ret, round(pct, 6) AS pct FROM fq", "holdings"))
def skill_fund_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fund_quarters(spark, sf_dir).select("fund_id", "start", R("ret", 6).alias("ret"), R("pct", 6).alias("pct"))


@query("skill_fund_summary", sql(FUND_Q_SQL + """
    SELECT fund_id, count(*) AS n, round(avg(pct), 6) AS mean_pct, round(avg(CASE WHEN pct > 50 THEN 1 ELSE 0 END), 6) AS share_above, round((avg(pct) - 50) / (28.87 / sqrt(count(*))), 6) AS z FROM fq GROUP BY 1""", "holdings"))
def skill_fund_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = (F.avg("pct") - 50) / (28.87 / F.sqrt(F.count("*").cast("double")))
    return fund_quarters(spark, sf_dir).groupBy("fund_id").agg(F.count("*").alias("n"), R(F.avg("pct"), 6).alias("mean_pct"), R(F.avg((F.col("pct") > 50).cast("double")), 6).alias("share_above"), R(z, 6).alias("z"))


@query("three_level_rollup", sql(FUND_Q_SQL + """, g AS (SELECT fq.*, n_regionkey AS region FROM fq JOIN supplier ON s_suppkey = fund_id JOIN nation ON n_nationkey = s_nationkey)
    SELECT region, fund_id, count(*) AS n, round(avg(pct), 6) AS mean_pct FROM g GROUP BY GROUPING SETS ((region, fund_id), (region), ())""", "holdings"))
def three_level_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    funds = read(spark, sf_dir, "supplier").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    rows = fund_quarters(spark, sf_dir).join(funds.select(F.col("s_suppkey").alias("fund_id"), F.col("n_regionkey").alias("region")), "fund_id")
    return rows.rollup("region", "fund_id").agg(F.count("*").alias("n"), R(F.avg("pct"), 6).alias("mean_pct"))


@query("percentile_summary", sql(FUND_Q_SQL + """
    SELECT start, count(*) AS n, round(quantile_cont(ret, 0.05), 6) AS p05, round(quantile_cont(ret, 0.5), 6) AS p50, round(quantile_cont(ret, 0.95), 6) AS p95, round(stddev_samp(ret), 6) AS sd FROM fq GROUP BY 1""", "holdings"))
def percentile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda p: R(F.percentile("ret", F.lit(p)), 6)
    return fund_quarters(spark, sf_dir).groupBy("start").agg(F.count("*").alias("n"), q(0.05).alias("p05"), q(0.5).alias("p50"), q(0.95).alias("p95"), R(F.stddev_samp("ret"), 6).alias("sd"))


@query("snapshot_asof_tolerance", """
    WITH q AS (SELECT o_orderkey, o_custkey % 100 AS user_id, CAST('2024-01-02' AS TIMESTAMP) + to_seconds(CAST(o_orderkey % 2400000 AS BIGINT)) AS at FROM orders),
    e AS (SELECT user_id % 100 AS user_id, ts, event_id, value FROM events)
    SELECT q.o_orderkey, e.event_id, round(e.value, 6) AS value FROM q LEFT JOIN LATERAL (
        SELECT event_id, value, ts FROM e WHERE e.user_id = q.user_id AND e.ts <= q.at ORDER BY ts DESC, event_id DESC LIMIT 1) e ON e.ts >= q.at - INTERVAL 6 HOUR""")
def snapshot_asof_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-02 00:00:00")) + F.col("o_orderkey") % 2400000)
    left = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("user_id"), at.alias("at"))
    right = read(spark, sf_dir, "events").select((F.col("user_id") % 100).alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", R("value", 6).alias("value"))
    return joins.as_of(left, right, ["user_id"], "at", "ts", ["event_id", "value"], tolerance=F.lit(6 * 3600.0), tie="event_id").select("o_orderkey", "event_id", "value")


@query("latest_filing", sql("""
    SELECT filing_id, cik, form, report_date FROM filings
    QUALIFY row_number() OVER (PARTITION BY cik, replace(form, '/A', ''), report_date ORDER BY filing_date DESC, form LIKE '%/A' DESC, filing_id DESC) = 1""", "filings"))
def latest_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = filings(spark, sf_dir).withColumn("base", F.regexp_replace("form", "/A$", ""))
    out = joins.latest(f, ["cik", "base", "report_date"], [F.col("filing_date").desc(), F.col("form").endswith("/A").desc(), F.col("filing_id").desc()])
    return out.select("filing_id", "cik", "form", "report_date")
