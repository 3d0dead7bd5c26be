"""Queries on investment rules over samples, one per kind, and on whole rule sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rulemark.operators import rules, sampling
from rulemark.plans.portfolio import K, SAMPLES_SQL, samples
from rulemark.plans.registry import query
from rulemark.sources.tables import assets, read, sql

R = F.round
MARKET_VARIANCE = 0.04
#: Stand-ins for a single-index model's beta and residual variance of an asset.
BETA, RESID = "(0.5 + (asset_id % 11) / 10.0::DOUBLE)", "((asset_id % 7 + 1) / 100.0::DOUBLE)"


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = samples(spark, sf_dir)
    return a.withColumns({"beta": 0.5 + (F.col("asset_id") % 11) / F.lit(10.0), "resid": (F.col("asset_id") % 7 + 1) / F.lit(100.0), "bw": F.col("bench") / F.lit(2000.0)})


TE_BETA, TE_RESID = 0.9, 0.0001
SELECTION = {
    "rule_cardinality": (lambda: rules.cardinality(K), f"count(*) = {K}"),
    "rule_sector_cap": (lambda: rules.sector_cap("PROMO", 3), "count(*) FILTER (sector = 'PROMO') <= 3"),
    "rule_exclusion_anti": (lambda: rules.exclusion((F.col("asset_id") % 40 == 0) | (F.col("country") == "Brand#13")), "count(*) FILTER (asset_id % 40 = 0 OR country = 'Brand#13') = 0"),
    "rule_min_avg": (lambda: rules.min_avg("esg", 25.0), "avg(esg) >= 25"),
    "rule_max_avg": (lambda: rules.max_avg("carbon", 906.0), "avg(carbon) <= 906"),
    "rule_count_bound": (lambda: rules.count_bound(F.col("esg") > 30, 3, 6), "count(*) FILTER (esg > 30) BETWEEN 3 AND 6"),
    "rule_avg_bound": (lambda: rules.avg_bound("esg", 20.0, 30.0), "avg(esg) BETWEEN 20 AND 30"),
    "rule_linear_threshold": (lambda: rules.linear_threshold(F.col("esg") - F.lit(25.0), 0.0), "coalesce(sum(esg - 25.0), 0) >= 0"),
    "rule_min_groups": (lambda: rules.min_groups("sector", 5), "count(DISTINCT sector) >= 5"),
    "rule_volatility_cap": (lambda: rules.volatility_cap(0.21, MARKET_VARIANCE), f"sqrt({MARKET_VARIANCE} * avg({BETA}) ** 2 + sum({RESID}) / (count(*) * count(*))) <= 0.21"),
    "rule_tracking_error_cap": (
        lambda: rules.tracking_error_cap(0.065, MARKET_VARIANCE, bench="bw", bench_risk=(TE_BETA, TE_RESID)),
        f"sqrt(greatest({MARKET_VARIANCE} * (avg({BETA}) - {TE_BETA}) ** 2 + sum({RESID}) / (count(*) * count(*)) - 2 * sum(bench / 2000.0::DOUBLE * {RESID}) / count(*) + {TE_RESID}, 0)) <= 0.065",
    ),
}


def _selection(name: str, rule: Callable[[], rules.Rule], condition: str) -> None:
    @query(name, sql(SAMPLES_SQL + f" SELECT sample_id, {condition} AS ok FROM s GROUP BY 1", "assets"))
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rules.evaluate(_held(spark, sf_dir), [rule()]).select("sample_id", "ok")


for _name, (_rule, _condition) in SELECTION.items():
    _selection(_name, _rule, _condition)

SET = ("rule_sector_cap", "rule_min_avg", "rule_min_groups", "rule_volatility_cap")
SET_SQL = " AND ".join(f"({SELECTION[n][1]})" for n in SET)
OK_SQL = SAMPLES_SQL + f", ok AS (SELECT sample_id, {SET_SQL} AS ok FROM s GROUP BY 1)"


def _set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.evaluate(_held(spark, sf_dir), [SELECTION[n][0]() for n in SET])


@query("rule_set_conjunction", sql(SAMPLES_SQL + " SELECT sample_id, " + ", ".join(f"{SELECTION[n][1]} AS {n[5:]}" for n in SET) + f", {SET_SQL} AS ok FROM s GROUP BY 1", "assets"))
def rule_set_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _set(spark, sf_dir)


@query("feasible_fraction_wilson", sql(OK_SQL + """, p AS (SELECT avg(CAST(ok AS INT)) AS p, count(*)::DOUBLE AS n FROM ok)
    SELECT CAST(n AS BIGINT) AS n, round(p, 6) AS fraction, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low,
        round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM p""", "assets"))
def feasible_fraction_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _set(spark, sf_dir).agg(F.avg(F.col("ok").cast("int")).alias("p"), F.count("*").alias("n"))
    low, high = sampling.wilson(F.col("p"), F.col("n").cast("double"))
    return p.select("n", R("p", 6).alias("fraction"), R(low, 6).alias("low"), R(high, 6).alias("high"))


@query("rejection_kept_n", sql(OK_SQL + " SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS kept_no FROM ok WHERE ok QUALIFY kept_no < 20", "assets"))
def rejection_kept_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.keep_first(_set(spark, sf_dir), 20).select("sample_id", F.col("kept_no").cast("long").alias("kept_no"))


@query("constraint_manager_effects", sql(OK_SQL + """, v AS (SELECT sample_id, avg(carbon) AS stat FROM s GROUP BY 1), j AS (SELECT * FROM v JOIN ok USING (sample_id)), fund AS (SELECT avg(carbon) AS stat FROM assets WHERE country = 'Brand#13')
    SELECT round(quantile_cont(j.stat, 0.5) FILTER (ok), 4) AS ruled_median, round(quantile_cont(j.stat, 0.5), 4) AS free_median, round(quantile_cont(j.stat, 0.5) FILTER (ok) - quantile_cont(j.stat, 0.5), 4) AS constraint_effect,
        round(any_value(fund.stat) - quantile_cont(j.stat, 0.5) FILTER (ok), 4) AS manager_effect FROM j, fund""", "assets"))
def constraint_manager_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = samples(spark, sf_dir).groupBy("sample_id").agg(F.avg("carbon").alias("stat")).join(_set(spark, sf_dir).select("sample_id", "ok"), "sample_id")
    fund = assets(spark, sf_dir).where("country = 'Brand#13'").agg(F.avg("carbon").alias("fund"))
    ruled, free = F.percentile(F.when(F.col("ok"), F.col("stat")), F.lit(0.5)), F.percentile("stat", F.lit(0.5))
    a = v.agg(ruled.alias("ruled"), free.alias("free")).crossJoin(fund)  # one row each
    return a.select(R("ruled", 4).alias("ruled_median"), R("free", 4).alias("free_median"), R(F.col("ruled") - F.col("free"), 4).alias("constraint_effect"), R(F.col("fund") - F.col("ruled"), 4).alias("manager_effect"))


WEIGHTED = {
    "w_holdings_range": (lambda: rules.holdings_range(10, 12), "count(*) FILTER (w > 1e-9) BETWEEN 10 AND 12"),
    "w_position_bound": (lambda: rules.position_bound(0.01, 0.16), "min(w) >= 0.01 - 1e-9 AND max(w) <= 0.16 + 1e-9"),
    "w_group_sum": (lambda: rules.group_sum(F.col("sector") == "ECONOMY", 0.05, 0.35), "coalesce(sum(w) FILTER (sector = 'ECONOMY'), 0) BETWEEN 0.05 - 1e-9 AND 0.35 + 1e-9"),
    "w_average_ineligible": (lambda: rules.weighted_average("score", 10.0, None), "coalesce(sum(CASE WHEN score IS NULL THEN w ELSE 0 END) <= 1e-9 AND sum(w * score) >= 10 - 1e-9, false)"),
    "w_average_renormalise": (lambda: rules.weighted_average("score", 25.0, None, "renormalise"), "coalesce(sum(w) FILTER (score IS NOT NULL) > 1e-9 AND sum(w * score) / sum(w) FILTER (score IS NOT NULL) >= 25 - 1e-9, false)"),
    "w_turnover": (lambda: rules.turnover("previous", 0.15), "sum(abs(w - previous)) / 2 <= 0.15 + 1e-9"),
}
WEIGHTS_SQL = SAMPLES_SQL + f", h AS (SELECT *, bench / sum(bench) OVER (PARTITION BY sample_id)::DOUBLE AS w, CASE WHEN asset_id % 25 <> 0 THEN esg END AS score, 1.0::DOUBLE / {K} AS previous FROM s)"


def _weighted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = sampling.weights(samples(spark, sf_dir), "benchmark")
    return a.withColumns({"score": F.when(F.col("asset_id") % 25 != 0, F.col("esg")), "previous": F.lit(1.0 / K)})


def _weighted(name: str, rule: Callable[[], rules.Rule], condition: str) -> None:
    @query(name, sql(WEIGHTS_SQL + f" SELECT sample_id, {condition} AS ok FROM h GROUP BY 1", "assets"))
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rules.evaluate(_weighted_rows(spark, sf_dir), [rule()]).select("sample_id", "ok")


for _name, (_rule, _condition) in WEIGHTED.items():
    _weighted(_name, _rule, _condition)


@query("w_violations", sql(WEIGHTS_SQL + ", r AS (SELECT sample_id, " + ", ".join(f"{c} AS {n[2:]}" for n, (_, c) in WEIGHTED.items()) + " FROM h GROUP BY 1) SELECT " + ", ".join(f"count(*) FILTER (NOT {n[2:]}) AS {n[2:]}" for n in WEIGHTED) + " FROM r", "assets"))
def w_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.evaluate(_weighted_rows(spark, sf_dir), [rules.Rule(n[2:], r().ok) for n, (r, _) in WEIGHTED.items()])
    return out.agg(*(F.count_if(~F.col(n[2:])).alias(n[2:]) for n in WEIGHTED))


@query("w_risk", sql(WEIGHTS_SQL + f" SELECT sample_id, round(sqrt({MARKET_VARIANCE} * sum(w * {BETA}) ** 2 + sum(w * w * {RESID})), 8) AS risk FROM h GROUP BY 1", "assets"))
def w_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _weighted_rows(spark, sf_dir).withColumns({"beta": 0.5 + (F.col("asset_id") % 11) / F.lit(10.0), "resid": (F.col("asset_id") % 7 + 1) / F.lit(100.0)})
    return a.groupBy("sample_id").agg(R(F.sqrt(MARKET_VARIANCE * F.pow(F.sum(F.col("w") * F.col("beta")), F.lit(2.0)) + F.sum(F.col("w") * F.col("w") * F.col("resid"))), 8).alias("risk"))


@query("quadratic_risk", sql(SAMPLES_SQL + f"""
    SELECT a.sample_id, round(sqrt(sum(CASE WHEN a.asset_id = b.asset_id THEN a.variance ELSE sqrt(a.variance * b.variance) * 0.2::DOUBLE END) / {K * K}), 8) AS risk FROM s a JOIN s b ON a.sample_id = b.sample_id GROUP BY 1""", "assets"))
def quadratic_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """w'Cw over the pairs of held assets only: K^2 of a sample, however many assets there are."""
    s = samples(spark, sf_dir).select("sample_id", "asset_id", "variance")
    pairs = s.select("sample_id", F.col("asset_id").alias("i"), F.col("variance").alias("vi")).join(s.select("sample_id", F.col("asset_id").alias("j"), F.col("variance").alias("vj")), "sample_id")
    cov = F.when(F.col("i") == F.col("j"), F.col("vi")).otherwise(F.sqrt(F.col("vi") * F.col("vj")) * 0.2)
    return pairs.groupBy("sample_id").agg(R(F.sqrt(F.sum(cov) / (K * K)), 8).alias("risk"))


@query("level_percentile_by_sector", sql("""
    SELECT asset_id, sector, esg < quantile_cont(esg, 0.3) OVER (PARTITION BY sector) AS below, esg < avg(esg) OVER () * 0.5 AS below_half_mean FROM assets""", "assets"))
def level_percentile_by_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members strictly below a level: their sector's 30th percentile, half the mean of all."""
    a = assets(spark, sf_dir)
    levels = a.groupBy("sector").agg(F.percentile("esg", F.lit(0.3)).alias("level"))
    mean = a.agg((F.avg("esg") * 0.5).alias("half"))
    return a.join(levels, "sector").crossJoin(F.broadcast(mean)).select("asset_id", "sector", (F.col("esg") < F.col("level")).alias("below"), (F.col("esg") < F.col("half")).alias("below_half_mean"))  # one row


@query("share_bounds_to_counts", """SELECT p_size AS k, CAST(floor(0.3 * p_size + 1e-9) AS BIGINT) AS max_count, CAST(ceil(0.3 * p_size - 1e-9) AS BIGINT) AS min_count FROM part GROUP BY 1""")
def share_bounds_to_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return read(spark, sf_dir, "part").select(F.col("p_size").alias("k")).distinct().select("k", F.floor(0.3 * k + 1e-9).alias("max_count"), F.ceil(0.3 * k - 1e-9).alias("min_count"))


@query("hold_to_end", sql(""", d AS (SELECT report_date, lead(report_date) OVER (ORDER BY report_date) AS nxt FROM (SELECT DISTINCT report_date FROM idx)),
    r AS (SELECT a.report_date AS start, a.asset_id, (b.value / b.balance) / (a.value / a.balance) AS g FROM idx a JOIN d USING (report_date) JOIN idx b ON b.report_date = d.nxt AND b.asset_id = a.asset_id),
    f AS (SELECT fund_id, asset_id, report_date AS d, value FROM holdings QUALIFY report_date = min(report_date) OVER (PARTITION BY fund_id)),
    s AS (SELECT fund_id, start, row_number() OVER (PARTITION BY fund_id ORDER BY start) AS i FROM (SELECT DISTINCT fund_id, start FROM f JOIN r USING (asset_id) WHERE start >= d)),
    w AS (
        SELECT fund_id, 0::BIGINT AS i, asset_id, CAST(value AS DOUBLE) AS w, 1.0::DOUBLE AS v FROM f SEMI JOIN s USING (fund_id)
        UNION ALL
        (WITH n AS (SELECT w.fund_id, s.i, w.asset_id, w, v, r.g FROM w JOIN s ON s.fund_id = w.fund_id AND s.i = w.i + 1 LEFT JOIN r ON r.asset_id = w.asset_id AND r.start = s.start),
        k AS (SELECT *, count(g) OVER p AS known, sum(w * g) OVER p AS grown, sum(CASE WHEN g IS NOT NULL THEN w END) OVER p AS held FROM n WINDOW p AS (PARTITION BY fund_id))
        SELECT fund_id, i, asset_id, CASE WHEN known > 0 THEN w * g ELSE w END, CASE WHEN known > 0 THEN v * grown / held ELSE v END FROM k WHERE known = 0 OR g IS NOT NULL)
    ) SELECT fund_id, CAST(i AS INT) AS n_periods, round(any_value(v) - 1, 6) AS path_return FROM (SELECT * FROM w QUALIFY i = max(i) OVER (PARTITION BY fund_id)) GROUP BY 1, 2""", "holdings", "idx").replace("WITH ", "WITH RECURSIVE ", 1))
def hold_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fund's first holdings carried to the end: names without a return leave, weights renormalise.

    A fold over a fund's periods in order; the state is its map of weights.
    """
    from rulemark.operators import prices
    from rulemark.sources.tables import holdings, index_holdings

    gross = (F.col("value1") / F.col("balance1")) / (F.col("value0") / F.col("balance0"))
    r = prices.paired(index_holdings(spark, sf_dir).withColumn("one", F.lit(1)), ["one"]).select("start", "asset_id", gross.alias("g"))
    h = holdings(spark, sf_dir)
    first = h.withColumn("d", F.min("report_date").over(Window.partitionBy("fund_id"))).where("d = report_date").select("fund_id", "asset_id", "d", "value")
    steps = first.join(r, "asset_id").where("start >= d").groupBy("fund_id", "start").agg(F.collect_list(F.struct("asset_id", "g")).alias("g"))
    steps = steps.groupBy("fund_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("start", "g"))), lambda x: F.map_from_entries(x["g"])).alias("steps"))
    w0 = first.groupBy("fund_id").agg(F.map_from_entries(F.collect_list(F.struct("asset_id", F.col("value").alias("w")))).alias("w"))
    # A fund's names are few, and the fold needs them together: rows of a fund are one state.
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x)

    def step(state, g):
        known = F.map_filter(state["w"], lambda k, _: F.element_at(g, k).isNotNull())
        grown = F.transform_values(known, lambda k, w: w * F.element_at(g, k))
        factor = F.when(F.size(known) > 0, total(grown) / total(known)).otherwise(1.0)
        return F.struct((state["value"] * factor).alias("value"), F.when(F.size(known) > 0, grown).otherwise(state["w"]).alias("w"))

    out = w0.join(steps, "fund_id")
    end = F.aggregate("steps", F.struct(F.lit(1.0).alias("value"), F.col("w").alias("w")), step)
    return out.select("fund_id", F.size("steps").alias("n_periods"), R(end["value"] - 1, 6).alias("path_return"))
