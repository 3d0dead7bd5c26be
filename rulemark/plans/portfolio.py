"""Queries on random portfolios: ranks, nulls, weights, exact laws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rulemark.operators import ordering, prices, sampling
from rulemark.operators.cuts import cut
from rulemark.operators.cuts import spread
from rulemark.plans.registry import query
from rulemark.sources.tables import assets, holdings, index_holdings, read, report_dates, sql

R = F.round
SEED, DRAWS, FUND = 20260101, 300, 7

UNIVERSE_SQL = """, d2 AS (SELECT DISTINCT report_date FROM idx ORDER BY 1 LIMIT 2), t AS (SELECT min(report_date) AS t0, max(report_date) AS t1 FROM d2),
uni AS (SELECT a.asset_id, a.value, (b.value / b.balance) / (a.value / a.balance) - 1 AS ret FROM idx a JOIN idx b USING (asset_id), t WHERE a.report_date = t0 AND b.report_date = t1),
held AS (SELECT h.fund_id, asset_id, h.value, uni.ret FROM holdings h JOIN uni USING (asset_id), t WHERE report_date = t0),
fund AS (SELECT fund_id, count(*) AS k, sum(value * ret) / sum(value) AS ret FROM held GROUP BY 1)"""
DRAWN_SQL = UNIVERSE_SQL + f""", ord AS (
    SELECT s.sample_id, asset_id, ret, row_number() OVER (PARTITION BY s.sample_id ORDER BY md5(concat_ws('|', '{SEED}', s.sample_id, asset_id)), asset_id) AS rank
    FROM uni CROSS JOIN (SELECT unnest(range(0, {DRAWS})) AS sample_id) s)"""


def universe(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(priced names of the first period with their return, funds' k and frozen return in it)."""
    dates = cut(report_dates(spark, sf_dir).orderBy("report_date").limit(2))  # distinct dates, a row a quarter
    span = dates.agg(F.min("report_date").alias("t0"), F.max("report_date").alias("t1"))
    at = lambda t, c: F.max(F.when(F.col("report_date") == F.col(t), F.col(c)))  # noqa: E731  a row an asset and date
    sides = index_holdings(spark, sf_dir, dates).crossJoin(F.broadcast(span)).groupBy("asset_id", "t0").agg(*(at(t, c).alias(f"{c}{t[1]}") for t in ("t0", "t1") for c in ("value", "balance")))  # one row
    gross = (F.col("value1") / F.col("balance1")) / (F.col("value0") / F.col("balance0"))
    # Written once, as the draws read the universe several times over, and in as many parts as there are cores: each name is drawn in many samples.
    uni = sides.where("value0 IS NOT NULL AND value1 IS NOT NULL").select("asset_id", "t0", F.col("value0").alias("value"), (gross - 1).alias("ret"))
    uni = cut(uni.repartition(spark.sparkContext.defaultParallelism, "asset_id"))
    held = holdings(spark, sf_dir, dates).select("fund_id", "asset_id", F.col("report_date").alias("t0"), F.col("value").alias("held")).join(uni.select("asset_id", "t0", "ret"), ["asset_id", "t0"])
    fund = cut(held.groupBy("fund_id").agg(F.count("*").alias("k"), (F.sum(F.col("held") * F.col("ret")) / F.sum("held")).alias("ret")))
    return uni.select("asset_id", "value", "ret"), fund


@query("rank_one_fund", sql(DRAWN_SQL + f""", nul AS (SELECT sample_id, avg(o.ret) AS ret FROM ord o, fund WHERE fund_id = {FUND} AND rank <= k GROUP BY 1)
    SELECT fund_id, k, round(any_value(f.ret), 6) AS fund_return, round(100 * avg(CASE WHEN round(n.ret, 12) = round(f.ret, 12) THEN 0.5 WHEN n.ret < f.ret THEN 1 ELSE 0 END), 4) AS percentile,
        round(quantile_cont(n.ret, 0.5), 6) AS null_median, count(*) AS n_draws FROM nul n, fund f WHERE fund_id = {FUND} GROUP BY 1, 2""", "holdings", "idx"))
def rank_one_fund(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where one fund's period return ranks among random equal-weight portfolios of as many names."""
    uni, fund = universe(spark, sf_dir)
    one = fund.where(F.col("fund_id") == FUND).select("fund_id", "k", F.col("ret").alias("fund_ret"))
    drawn = sampling.first_draws(uni.select("asset_id", "ret"), one.select("k"), DRAWS, SEED).crossJoin(F.broadcast(one))  # one row
    null = drawn.groupBy("sample_id", "fund_id", "k", "fund_ret").agg(F.avg("ret").alias("ret"))
    rank = sampling.mid_rank(R("ret", 12), R("fund_ret", 12))
    return null.groupBy("fund_id", "k").agg(R(F.first("fund_ret"), 6).alias("fund_return"), R(rank, 4).alias("percentile"), R(F.percentile("ret", F.lit(0.5)), 6).alias("null_median"), F.count("*").alias("n_draws"))


RUNNING_SQL = DRAWN_SQL + """, run AS (SELECT sample_id, rank AS k, avg(ret) OVER (PARTITION BY sample_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS ret FROM ord),
nul AS (SELECT f.fund_id, f.k, f.ret AS fund_ret, r.sample_id, r.ret FROM run r JOIN fund f USING (k))"""


def null_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fund_id, k, fund_ret, sample_id, ret): all funds' null draws from the same orders.

    The running mean along one random order is the return of its first k names for
    every k, so funds of all sizes share the draws.
    """
    uni, fund = universe(spark, sf_dir)
    w = Window.partitionBy("sample_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    run = sampling.first_draws(uni.select("asset_id", "ret"), fund.agg(F.max("k").alias("k")), DRAWS, SEED).select("sample_id", F.col("rank").cast("long").alias("k"), F.avg("ret").over(w).alias("ret"))
    return run.join(fund.select("fund_id", "k", F.col("ret").alias("fund_ret")), "k")


@query("rank_all_funds", sql(RUNNING_SQL + """
    SELECT fund_id, k, round(fund_ret, 6) AS fund_return, round(100 * avg(CASE WHEN round(ret, 12) = round(fund_ret, 12) THEN 0.5 WHEN ret < fund_ret THEN 1 ELSE 0 END), 4) AS percentile FROM nul GROUP BY 1, 2, 3""", "holdings", "idx"))
def rank_all_funds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = sampling.mid_rank(R("ret", 12), R("fund_ret", 12))
    return null_of_all(spark, sf_dir).groupBy("fund_id", "k", R("fund_ret", 6).alias("fund_return")).agg(R(rank, 4).alias("percentile"))


@query("null_distribution_quantiles", sql(RUNNING_SQL + """
    SELECT k, round(quantile_cont(ret, 0.05), 6) AS p05, round(quantile_cont(ret, 0.5), 6) AS p50, round(quantile_cont(ret, 0.95), 6) AS p95, round(quantile_disc(ret, 0.5), 6) AS median_low,
        round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS sd FROM (SELECT DISTINCT k, sample_id, ret FROM nul) GROUP BY 1""", "holdings", "idx"))
def null_distribution_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda p: R(F.percentile("ret", F.lit(p)), 6)
    low = R(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ret)"), 6)
    one = null_of_all(spark, sf_dir).select("k", "sample_id", "ret").distinct()
    return one.groupBy("k").agg(q(0.05).alias("p05"), q(0.5).alias("p50"), q(0.95).alias("p95"), low.alias("median_low"), R(F.avg("ret"), 6).alias("mean"), R(F.stddev_samp("ret"), 6).alias("sd"))


@query("median_ci", sql(RUNNING_SQL + """, o AS (SELECT k, ret, row_number() OVER (PARTITION BY k ORDER BY ret) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM (SELECT DISTINCT k, sample_id, ret FROM nul))
    SELECT k, round(min(CASE WHEN i = greatest(floor(n / 2.0 - 0.98 * sqrt(n)), 0) THEN ret END), 6) AS low, round(min(CASE WHEN i = least(ceil(n / 2.0 + 0.98 * sqrt(n)), n - 1) THEN ret END), 6) AS high FROM o GROUP BY 1""", "holdings", "idx"))
def median_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = null_of_all(spark, sf_dir).select("k", "sample_id", "ret").distinct()
    o = one.withColumns({"i": F.row_number().over(Window.partitionBy("k").orderBy("ret")) - 1, "n": F.count("*").over(Window.partitionBy("k"))})
    low = F.greatest(F.floor(F.col("n") / 2 - 0.98 * F.sqrt("n")), F.lit(0))
    high = F.least(F.ceil(F.col("n") / 2 + 0.98 * F.sqrt("n")), F.col("n") - 1)
    at = lambda c: R(F.min(F.when(F.col("i") == c, F.col("ret"))), 6)
    return o.groupBy("k").agg(at(low).alias("low"), at(high).alias("high"))


@query("attribution_total_return", sql(""", d AS (SELECT report_date, lead(report_date) OVER (ORDER BY report_date) AS nxt FROM (SELECT DISTINCT report_date FROM idx)),
    r AS (SELECT a.report_date AS start, a.asset_id, (b.value / b.balance) / (a.value / a.balance) - 1 AS ret FROM idx a JOIN d USING (report_date) JOIN idx b ON b.report_date = d.nxt AND b.asset_id = a.asset_id),
    f AS (SELECT fund_id, h.report_date AS start, sum(value * ret) / sum(value) AS ret FROM holdings h JOIN r ON r.start = h.report_date AND r.asset_id = h.asset_id GROUP BY 1, 2)
    SELECT fund_id, count(*) AS n_periods, round(sum(ln(1 + ret)), 6) AS log_growth, round(CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * 2 ELSE 0 END, 6) AS sharpe FROM f GROUP BY 1""", "holdings", "idx"))
def attribution_total_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = prices.paired(index_holdings(spark, sf_dir).withColumn("one", F.lit(1)), ["one"])
    r = idx.select(F.col("start").alias("report_date"), "asset_id", ((F.col("value1") / F.col("balance1")) / (F.col("value0") / F.col("balance0")) - 1).alias("ret"))
    f = holdings(spark, sf_dir).join(r, ["report_date", "asset_id"]).groupBy("fund_id", "report_date").agg((F.sum(F.col("value") * F.col("ret")) / F.sum("value")).alias("ret"))
    sharpe = F.when(F.stddev_samp("ret") > 0, F.avg("ret") / F.stddev_samp("ret") * 2).otherwise(0.0)
    return f.groupBy("fund_id").agg(F.count("*").alias("n_periods"), R(F.sum(F.ln(1 + F.col("ret"))), 6).alias("log_growth"), R(sharpe, 6).alias("sharpe"))


# Samples of K of all assets, with a stand-in benchmark weight and variance.
K, M = 12, 200
SAMPLES_SQL = f""", small AS (SELECT asset_id, sector, country, esg, carbon, asset_id % 9 + 1 AS bench, (asset_id % 7 + 1) / 100.0::DOUBLE AS variance FROM assets),
s AS (SELECT * FROM (SELECT m.sample_id, small.*, row_number() OVER (PARTITION BY m.sample_id ORDER BY md5(concat_ws('|', '1', m.sample_id, asset_id)), asset_id) AS rank
    FROM small CROSS JOIN (SELECT unnest(range(0, {M})) AS sample_id) m) WHERE rank <= {K})"""


def universe_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets(spark, sf_dir).withColumns({"bench": F.col("asset_id") % 9 + 1, "variance": (F.col("asset_id") % 7 + 1) / F.lit(100.0)})


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written once in as many parts as there are cores: the table is small, its draws are many.
    universe = cut(universe_assets(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism, "asset_id"))
    return sampling.k_subsets(universe, K, M, 1)


@query("random_k_subsets", sql(SAMPLES_SQL + " SELECT sample_id, asset_id FROM s", "assets"))
def random_k_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("sample_id", "asset_id")


def _weighted(policy: str, raw: str) -> None:
    @query(f"weights_{policy}", sql(SAMPLES_SQL + f" SELECT sample_id, asset_id, round({raw} / sum({raw}) OVER (PARTITION BY sample_id), 8) AS w FROM s", "assets"))
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sampling.weights(samples(spark, sf_dir), policy).select("sample_id", "asset_id", R("w", 8).alias("w"))


for _policy, _raw in {"equal": "1.0::DOUBLE", "benchmark": "CAST(bench AS DOUBLE)", "inverse_vol": "(1 / sqrt(variance))", "esg_tilt": "esg"}.items():
    _weighted(_policy, _raw)

CAP = 0.12
CAPPED_SQL = SAMPLES_SQL + f""", w0 AS (SELECT sample_id, asset_id, bench / sum(bench) OVER (PARTITION BY sample_id) AS w FROM s),
    c AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY w DESC, asset_id) AS r FROM w0),
    j AS (SELECT a.sample_id, a.r - 1 AS j FROM c a JOIN c b ON a.sample_id = b.sample_id AND b.r >= a.r GROUP BY a.sample_id, a.r, a.w HAVING a.w * (1 - {CAP} * (a.r - 1)) / sum(b.w) <= {CAP} + 1e-12),
    m AS (SELECT sample_id, min(j) AS j FROM j GROUP BY 1), t AS (SELECT c.sample_id, any_value(j) AS j, sum(w) FILTER (r > j) AS rest FROM c JOIN m USING (sample_id) GROUP BY 1)
    SELECT c.sample_id, asset_id, round(CASE WHEN r <= j THEN {CAP} ELSE w * (1 - {CAP} * j) / rest END, 8) AS w FROM c JOIN t USING (sample_id)"""


@query("weights_capped", sql(CAPPED_SQL, "assets"))
def weights_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.capped(sampling.weights(samples(spark, sf_dir), "benchmark"), CAP).select("sample_id", "asset_id", R("w", 8).alias("w"))


@query("weighted_quantile", sql(SAMPLES_SQL + """, c AS (SELECT sample_id, carbon, sum(bench) OVER (PARTITION BY sample_id ORDER BY carbon) AS c, sum(bench) OVER (PARTITION BY sample_id) AS t FROM s)
    SELECT sample_id, min(carbon) AS quantile FROM c WHERE c >= 0.25 * t - 1e-12 GROUP BY 1""", "assets"))
def weighted_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.weighted_quantile(samples(spark, sf_dir), "carbon", "bench", 0.25, ["sample_id"])


@query("enumerate_k_subsets", """WITH i AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS a FROM lineitem), u AS (SELECT o, a, CAST(p_size AS DOUBLE) AS esg FROM i JOIN part ON p_partkey = a)
    SELECT x.o AS order_id, x.a || '|' || y.a || '|' || z.a AS members, round((x.esg + y.esg + z.esg) / 3, 6) AS esg FROM u x JOIN u y ON x.o = y.o AND x.a < y.a JOIN u z ON y.o = z.o AND y.a < z.a""")
def enumerate_k_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sets of three assets of every order, with their mean score."""
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("asset_id"))
    # Scores come before the sets, so that nothing is shuffled once there are sets; an order's assets meet where its lines are.
    u = spread(items.join(assets(spark, sf_dir).select("asset_id", "esg"), "asset_id"), "order_id").groupBy("order_id", "asset_id").agg(F.first("esg").alias("esg"))
    x, y, z = (u.select("order_id", F.col("asset_id").alias(f"a{i}"), F.col("esg").alias(f"e{i}")) for i in range(3))
    held = x.join(y, "order_id").where("a0 < a1").join(z, "order_id").where("a1 < a2")
    return held.select("order_id", F.concat_ws("|", "a0", "a1", "a2").alias("members"), R((F.col("e0") + F.col("e1") + F.col("e2")) / 3, 6).alias("esg"))


INC_SQL = SAMPLES_SQL + f""", p AS (SELECT asset_id, count(s.asset_id) / {M}.0::DOUBLE AS freq FROM small LEFT JOIN s USING (asset_id) GROUP BY 1)"""


@query("inclusion_error", sql(INC_SQL + f" SELECT asset_id, round(freq, 6) AS freq, round(freq - {K}::DOUBLE / (SELECT count(*) FROM small), 6) AS error FROM p", "assets"))
def inclusion_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = universe_assets(spark, sf_dir)
    seen = samples(spark, sf_dir).groupBy("asset_id").agg(F.count("*").alias("n"))
    freq = F.coalesce(F.col("n"), F.lit(0)) / F.lit(float(M))
    share = u.agg((K / F.count("*")).alias("share"))
    return u.select("asset_id").join(seen, "asset_id", "left").crossJoin(F.broadcast(share)).select("asset_id", R(freq, 6).alias("freq"), R(freq - F.col("share"), 6).alias("error"))  # one row


# Single draws from six states against their exact law.
LAW_SQL = """WITH e AS (SELECT p_type AS state, count(*) AS n FROM part GROUP BY 1), exact AS (SELECT state, n / sum(n) OVER ()::DOUBLE AS p FROM e),
o AS (SELECT p_type AS state, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), seen AS (SELECT state, n / sum(n) OVER ()::DOUBLE AS q, n, sum(n) OVER () AS total FROM o)"""


def _law(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("state"))
    whole = Window.partitionBy()  # one row a state
    share = lambda df, name: df.groupBy("state").count().select("state", "count", (F.col("count") / F.sum("count").over(whole)).alias(name))
    exact = share(part, "p").drop("count")
    return exact.join(share(read(spark, sf_dir, "lineitem").select("l_partkey").join(part, "l_partkey"), "q"), "state", "full")


@query("exact_tv_kl", LAW_SQL + """ SELECT round(sum(abs(coalesce(q, 0) - coalesce(p, 0))) / 2, 8) AS tv, CASE WHEN count(*) = count(q) THEN round(sum(q * ln(q / p)), 8) END AS kl FROM exact FULL JOIN seen USING (state)""")
def exact_tv_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    kl = F.when(F.count("*") == F.count("q"), R(F.sum(F.col("q") * F.ln(F.col("q") / F.col("p"))), 8))
    return _law(spark, sf_dir).agg(R(F.sum(F.abs(zero("q") - zero("p"))) / 2, 8).alias("tv"), kl.alias("kl"))


@query("collision_chi2", LAW_SQL + " SELECT round(sum(n * (n - 1.0)) / (any_value(total) * (any_value(total) - 1.0)), 8) AS collisions FROM seen")
def collision_chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("count").cast("double")
    return _law(spark, sf_dir).agg(R(F.sum(n * (n - 1)) / (F.sum(n) * (F.sum(n) - 1)), 8).alias("collisions"))


@query("ks_w1", """
    WITH v AS (SELECT round(o_totalprice, 0) AS x, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS a, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS b FROM orders WHERE o_orderstatus IN ('F', 'O')),
    g AS (SELECT x, sum(a) AS a, sum(b) AS b FROM v GROUP BY 1), c AS (SELECT x, sum(a) OVER w / (SELECT sum(a) FROM g)::DOUBLE AS fa, sum(b) OVER w / (SELECT sum(b) FROM g)::DOUBLE AS fb, lead(x) OVER w2 - x AS step FROM g WINDOW w AS (ORDER BY x), w2 AS (ORDER BY x))
    SELECT round(max(abs(fa - fb)), 8) AS ks, round(sum(abs(fa - fb) * coalesce(step, 0)), 4) AS w1 FROM c""")
def ks_w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_ = lambda s: F.sum((F.col("o_orderstatus") == s).cast("double"))
    g = read(spark, sf_dir, "orders").where("o_orderstatus IN ('F', 'O')").groupBy(R("o_totalprice", 0).alias("x")).agg(is_("F").alias("a"), is_("O").alias("b"))
    c = ordering.running(g, "x", ["a", "b"])
    gap = F.abs(F.try_divide("a_run", F.col("a_all")) - F.try_divide("b_run", F.col("b_all")))
    c = c.select(gap.alias("d"), (F.col("next") - F.col("x")).alias("step"))
    return c.agg(R(F.max("d"), 8).alias("ks"), R(F.sum(F.col("d") * F.coalesce("step", F.lit(0.0))), 4).alias("w1"))


@query("rank_bins", """SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) * 16 / count(*) OVER ()) AS BIGINT) AS bin FROM orders""")
def rank_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = ordering.ranked(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])
    return ranks.select("o_orderkey", F.floor(F.col("rank") * 16 / F.col("rank_total")).alias("bin"))


@query("cvar", sql(RUNNING_SQL + """, tail AS (SELECT DISTINCT k, sample_id, ret FROM nul), q AS (SELECT k, quantile_disc(ret, 0.1) AS q FROM tail GROUP BY 1)
    SELECT k, round(avg(ret), 6) AS cvar FROM tail JOIN q USING (k) WHERE ret <= q GROUP BY 1""", "holdings", "idx"))
def cvar(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = null_of_all(spark, sf_dir).select("k", "sample_id", "ret").distinct()
    q = t.groupBy("k").agg(F.expr("percentile_disc(0.1) WITHIN GROUP (ORDER BY ret)").alias("q"))
    return t.join(q, "k").where("ret <= q").groupBy("k").agg(R(F.avg("ret"), 6).alias("cvar"))


@query("effective_sample_size", sql(SAMPLES_SQL + " SELECT sample_id, round(sum(bench) * sum(bench) / sum(bench * bench)::DOUBLE, 6) AS ess FROM s GROUP BY 1", "assets"))
def effective_sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("bench").cast("double")
    return samples(spark, sf_dir).groupBy("sample_id").agg(R(F.sum(b) * F.sum(b) / F.sum(b * b), 6).alias("ess"))
