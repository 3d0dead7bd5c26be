"""Queries on weight lattices, swaps between states, exact counts and monotone fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemark.functions import estimates
from rulemark.operators import counts, lattice
from rulemark.plans.registry import query
from rulemark.sources.tables import assets, read, sql

R = F.round

# Weights of the regions in twentieths.
GRID = lattice.Grid(n=5, units=20, low=2, high=9, k_min=3, k_max=5)
GRID_SQL = f"""v AS (SELECT 0 AS q UNION ALL SELECT unnest(range({GRID.low}, {GRID.high + 1}))),
    p AS (SELECT [a.q, b.q, c.q, d.q, e.q] AS point, row_number() OVER (ORDER BY a.q, b.q, c.q, d.q, e.q) - 1 AS nth FROM v a, v b, v c, v d, v e
        WHERE a.q + b.q + c.q + d.q + e.q = {GRID.units} AND (a.q > 0)::INT + (b.q > 0)::INT + (c.q > 0)::INT + (d.q > 0)::INT + (e.q > 0)::INT BETWEEN {GRID.k_min} AND {GRID.k_max})"""


def _text(point: str):
    return F.concat_ws("-", F.col(point).cast("array<string>"))


def _worth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point, value): every lattice portfolio of the regions at their mean balance."""
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"))
    value = read(spark, sf_dir, "customer").join(nation, "c_nationkey").groupBy("region").agg(F.avg("c_acctbal").alias("value"))
    values = value.agg(F.transform(F.sort_array(F.collect_list(F.struct("region", "value"))), lambda s: s["value"]).alias("values"))  # five values
    worth = F.aggregate(F.zip_with("point", "values", lambda q, v: q * v), F.lit(0.0), lambda a, x: a + x) / GRID.units
    return lattice.points(spark, GRID).where(GRID.contains(F.col("point"))).crossJoin(F.broadcast(values)).select("point", worth.alias("value"))  # one row


@query("grid_points", f"""WITH {GRID_SQL}, r AS (SELECT n_regionkey AS region, avg(c_acctbal) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), l AS (SELECT list(value ORDER BY region) AS l FROM r)
    SELECT array_to_string(point, '-') AS point, round(list_sum(list_transform(list_zip(point, l), lambda z: z[1] * z[2])) / {GRID.units}, 4) AS value FROM p, l""")
def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lattice portfolios of the five regions, with their value."""
    return _worth(spark, sf_dir).select(_text("point").alias("point"), R("value", 4).alias("value"))


@query("grid_draws", f"""WITH {GRID_SQL}, o AS (SELECT o_orderkey, CAST('0x' || md5('7|' || o_orderkey)[1:13] AS BIGINT) % (SELECT count(*) FROM p) AS nth FROM orders)
    SELECT o_orderkey, array_to_string(point, '-') AS point FROM o JOIN p USING (nth)""")
def grid_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform lattice portfolio for each order, unranked from its hash."""
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(7), "o_orderkey").cast("binary")), 1, 13), 16, 10).cast("long") % GRID.size
    drawn = lattice.nth_point(read(spark, sf_dir, "orders").select("o_orderkey", number.alias("nth")), "nth", GRID)
    return drawn.select("o_orderkey", _text("point").alias("point"))


@query("grid_extremes", f"""WITH {GRID_SQL}, r AS (SELECT n_regionkey AS region, avg(c_acctbal) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), l AS (SELECT list(value ORDER BY region) AS l FROM r),
    s AS (SELECT list_sum(list_transform(list_zip(point, l), lambda z: z[1] * z[2])) / {GRID.units} AS value FROM p, l)
    SELECT count(*) AS n, round(min(value), 4) AS lowest, round(max(value), 4) AS highest FROM s""")
def grid_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least and greatest value that a lattice portfolio of the regions reaches."""
    return _worth(spark, sf_dir).agg(F.count("*").alias("n"), R(F.min("value"), 4).alias("lowest"), R(F.max("value"), 4).alias("highest"))


# The groups that an order holds, of twelve, are its state; states of large mean quantity are feasible.
BITS, LEAST = 12, 26
STATES_SQL = f"""o AS (SELECT l_orderkey, bit_or(CAST(1 AS BIGINT) << CAST(l_suppkey % {BITS} AS INT)) AS code, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1),
    f AS (SELECT code, bit_count(code) AS k FROM o GROUP BY 1 HAVING sum(q) / sum(n) >= {LEAST}),
    e AS (SELECT a.code AS a, b.code AS b FROM f a JOIN f b ON a.k = b.k AND bit_count(xor(a.code, b.code)) = 2)"""
COMPONENTS_SQL = f"""WITH RECURSIVE {STATES_SQL}, reach(a, b) AS (SELECT code, code FROM f UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
    c AS (SELECT a AS code, min(b) AS component FROM reach GROUP BY 1)"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("l_suppkey") % BITS).cast("int"))
    o = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bit_or(held).alias("code"), F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    mean = F.sum("q") / F.sum("n")
    return o.groupBy("code").agg(mean.alias("mean")).where(F.col("mean") >= LEAST).select("code", F.bit_count("code").alias("k"))


@query("swap_component_labels", COMPONENTS_SQL + " SELECT code, component FROM c")
def swap_component_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.swap_components(_states(spark, sf_dir), BITS).select("code", "component")


@query("swap_connectivity", COMPONENTS_SQL + """, s AS (SELECT k, component, count(*) AS n FROM c JOIN f USING (code) GROUP BY ALL)
    SELECT k, count(*) AS n_components, round(max(n) / sum(n)::DOUBLE, 8) AS largest, round(sum(n * n) / (sum(n) * sum(n))::DOUBLE, 8) AS start_coverage, count(*) FILTER (n = 1) AS n_isolated FROM s GROUP BY 1""")
def swap_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For states of each size: how many islands swaps leave, and the share that a random start reaches."""
    s = lattice.swap_components(_states(spark, sf_dir), BITS).groupBy("k", "component").agg(F.count("*").cast("double").alias("n"))
    n = F.col("n")
    share = R(F.sum(n * n) / (F.sum(n) * F.sum(n)), 8)
    return s.groupBy("k").agg(F.count("*").alias("n_components"), R(F.max(n) / F.sum(n), 8).alias("largest"), share.alias("start_coverage"), F.count(F.when(n == 1, 1)).alias("n_isolated"))


@query("swap_move_rates", f"""WITH {STATES_SQL}, d AS (SELECT code, k, count(e.b) AS degree FROM f LEFT JOIN e ON e.a = f.code GROUP BY 1, 2)
    SELECT k, count(*) AS n, round(avg(degree / (k * ({BITS} - k))::DOUBLE), 8) AS move_rate FROM d WHERE k BETWEEN 1 AND {BITS - 1} GROUP BY 1""")
def swap_move_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean share of swap proposals that lead to another feasible state; the rest stay."""
    d = lattice.swap_degrees(_states(spark, sf_dir), BITS).where(F.col("k").between(1, BITS - 1))
    return d.groupBy("k").agg(F.count("*").alias("n"), R(F.avg(F.col("degree") / (F.col("k") * (BITS - F.col("k")))), 8).alias("move_rate"))


COUNTED, SCORES = 3, 16
CELLS_SQL = sql(f""", c AS (SELECT sector, CAST(esg AS BIGINT) % {SCORES} AS score, count(*)::HUGEINT AS n FROM assets WHERE esg IS NOT NULL GROUP BY ALL)""", "assets")


@query("subset_count_exact", CELLS_SQL + """ SELECT x.score + y.score + z.score AS total, CAST(CAST(sum(x.n * y.n * z.n) AS HUGEINT) AS VARCHAR) AS ways FROM c x JOIN c y ON x.sector < y.sector JOIN c z ON y.sector < z.sector GROUP BY 1""")
def subset_count_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sets of three assets of different sectors have each total score: exact, without listing any."""
    scored = assets(spark, sf_dir).where("esg IS NOT NULL").select("sector", (F.col("esg").cast("long") % SCORES).alias("score"))
    return counts.score_counts(scored, COUNTED, F.col("score"), F.col("sector"), 1)


#: Four names, two of a sector at most; one or two of high score, and a mean carbon no worse than the universe's, in fifths of its range.
PICKED, CAP, BINS, TOP = 4, 2, 5, 40
WALK_SQL = f"""s AS (
        SELECT 0::BIGINT AS i, '' AS sector, 0 AS taken, 0 AS n, 0::BIGINT AS a, 0::BIGINT AS b, 1::HUGEINT AS ways
        UNION ALL
        (WITH t AS (SELECT c.i, c.sector, CASE WHEN c.sector = s.sector THEN taken ELSE 0 END + j AS taken, s.n + j AS n, s.a + j * c.a AS a, s.b + j * c.b AS b, ways * CASE j WHEN 0 THEN 1 WHEN 1 THEN m ELSE m * (m - 1) // 2 END AS ways
            FROM s JOIN c ON c.i = s.i + 1 JOIN (SELECT unnest(range({CAP + 1})) AS j) ON j <= m)
        SELECT i, sector, taken, n, @a AS a, @b AS b, CAST(sum(ways) AS HUGEINT) FROM t, l WHERE taken <= {CAP} AND n <= {PICKED} @where GROUP BY ALL)
    ), f AS (SELECT a, b, CAST(sum(ways) AS HUGEINT) AS ways FROM s WHERE i = (SELECT count(*) FROM c) AND n = {PICKED} GROUP BY 1, 2)"""
RANGE_SQL = """r AS (SELECT min(carbon) AS lo, max(carbon) AS hi, min(esg) AS elo, max(esg) AS ehi, round(avg(carbon), 2) AS most FROM assets)"""
CELL_SQL = """c AS (SELECT *, row_number() OVER (ORDER BY sector, a, b) AS i FROM (SELECT sector, a, b, count(*)::HUGEINT AS m FROM w GROUP BY 1, 2, 3))"""


@query("subset_count_rules", sql(f""", {RANGE_SQL}, w AS (SELECT sector, (esg > {TOP})::INT AS a, CAST(round({BINS - 1} / (hi - lo) * (hi - carbon)) AS BIGINT) AS b FROM assets, r), {CELL_SQL},
    l AS (SELECT CAST(ceil({BINS - 1} / (hi - lo) * {PICKED} * (hi - most) - 1e-9) AS BIGINT) AS t FROM r), {WALK_SQL.replace("@a", "a").replace("@b", "least(b, t)").replace("@where", "AND a <= 2")}
    SELECT CAST(CAST(coalesce(sum(ways), 0) AS HUGEINT) AS VARCHAR) AS ways FROM f, l WHERE a >= 1 AND b >= t""", "assets").replace("WITH ", "WITH RECURSIVE ", 1))
def subset_count_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sets of four assets obey sector caps, a count bound and a rounded average at once."""
    a = assets(spark, sf_dir)
    lo, hi, most = a.agg(F.min("carbon"), F.max("carbon"), F.round(F.avg("carbon"), 2)).first()
    scale = (BINS - 1) / (hi - lo)
    axes = [counts.Axis((F.col("esg") > TOP).cast("int"), 1, 2), counts.Axis(F.round(scale * (hi - F.col("carbon"))), counts.thresholds(scale * PICKED * (hi - most), PICKED, False)[1])]
    return counts.subset_count(a, PICKED, axes, F.col("sector"), CAP)


FUND_ESG = 24.5
_AT = lambda need, k: f"CAST(ceil({need} {k} - 1e-9) AS BIGINT)"
_PAST = lambda need, k: f"CAST(floor({need} {k} + 1e-9) AS BIGINT) + 1"
_MODES = (f"- {PICKED / 2}", "", f"+ {PICKED / 2}")


@query("percentile_bounds", sql(f""", {RANGE_SQL}, w AS (SELECT sector, CAST(round({BINS - 1} / (hi - lo) * (hi - carbon)) AS BIGINT) AS a, CAST(round({BINS - 1} / (ehi - elo) * (ehi - esg)) AS BIGINT) AS b FROM assets, r), {CELL_SQL},
    x AS (SELECT {BINS - 1} / (hi - lo) * {PICKED} * (hi - most) AS na, {BINS - 1} / (ehi - elo) * {PICKED} * (ehi - {FUND_ESG}::DOUBLE) AS nb FROM r),
    l AS (SELECT {", ".join(f"{_AT('na', m)} AS a{i}, {_PAST('nb', m)} AS b{i}" for i, m in enumerate(_MODES))} FROM x), {WALK_SQL.replace("@a", "least(a, a2)").replace("@b", "least(b, b2)").replace("@where", "")},
    g AS (SELECT {", ".join(f"coalesce(sum(ways) FILTER (a >= a{i}), 0) AS f{i}, coalesce(sum(ways) FILTER (a >= a{i} AND b >= b{i}), 0) AS g{i}" for i in range(3))} FROM f, l)
    SELECT CAST(CAST(f1 AS HUGEINT) AS VARCHAR) AS ruled, CAST(CAST(g1 AS HUGEINT) AS VARCHAR) AS below, round(CASE WHEN f0 > 0 THEN least(g2::DOUBLE / f0::DOUBLE, 1) ELSE 0 END, 9) AS low,
        round(CASE WHEN f1 > 0 THEN g1::DOUBLE / f1::DOUBLE END, 9) AS share, round(CASE WHEN f2 > 0 THEN least(g0::DOUBLE / f2::DOUBLE, 1) ELSE 1 END, 9) AS high FROM g""", "assets").replace("WITH ", "WITH RECURSIVE ", 1))
def percentile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all sets of four assets under caps and a carbon rule, the share whose mean score lies below a fund's, between exact bounds."""
    a = assets(spark, sf_dir)
    most = a.agg(F.round(F.avg("carbon"), 2)).first()[0]
    below = counts.Mean("esg", FUND_ESG, at_least=False, strict=True)
    found = counts.share_below(a, PICKED, [counts.Mean("carbon", most, at_least=False)], below, BINS, F.col("sector"), CAP)
    return found.select("ruled", "below", R("low", 9).alias("low"), R("share", 9).alias("share"), R("high", 9).alias("high"))


@query("isotonic_price", """WITH g AS (SELECT l_returnflag AS flag, l_quantity AS x, sum(l_discount) AS s, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1, 2),
    c AS (SELECT *, sum(s) OVER o AS cs, sum(w) OVER o AS cw FROM g WINDOW o AS (PARTITION BY flag ORDER BY x)),
    a AS (SELECT i.flag, i.x AS x0, j.x AS x1, (j.cs - i.cs + i.s) / (j.cw - i.cw + i.w) AS mean FROM c i JOIN c j ON i.flag = j.flag AND j.x >= i.x),
    m AS (SELECT k.flag, k.x, a.x0, min(a.mean) AS least FROM c k JOIN a ON a.flag = k.flag AND a.x0 <= k.x AND a.x1 >= k.x GROUP BY ALL)
    SELECT flag, x, round(max(least), 8) AS fit FROM m GROUP BY 1, 2""")
def isotonic_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The discount as a rising function of quantity, for each return flag."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("x"), "l_discount", F.lit(1).alias("w"))
    fit = estimates.isotonic(rows, ["flag"], "x", "l_discount", "w")
    return fit.select("flag", "x", R("fit", 8).alias("fit"))


@query("uniformity_stats", """WITH p AS (SELECT c_mktsegment AS state, count(*)::DOUBLE AS n, c_mktsegment > 'C' AS feasible FROM customer GROUP BY 1), q AS (SELECT n / sum(n) OVER () AS q, count(*) OVER () AS m, sum(n) OVER () AS f FROM p WHERE feasible)
    SELECT round(any_value(f) / (SELECT sum(n) FROM p), 8) AS p_feasible, round(any_value(m) * sum(q * q) - 1, 8) AS chi2, round(sum(abs(q - 1.0::DOUBLE / m)) / 2, 8) AS tv, round(any_value(m) * min(q), 8) AS min_ratio, count(*) AS m FROM q""")
def uniformity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a law, seen on its feasible states alone, is from the uniform one."""
    p = read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("state")).agg(F.count("*").cast("double").alias("n"))
    total = p.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("state") > "C", F.col("n"))).alias("f"), F.count(F.when(F.col("state") > "C", 1)).alias("m"))
    q = p.where("state > 'C'").crossJoin(F.broadcast(total)).withColumn("q", F.col("n") / F.col("f"))  # one row
    m = F.max("m")
    return q.agg(R(F.max(F.col("f") / F.col("all")), 8).alias("p_feasible"), R(m * F.sum(F.col("q") * F.col("q")) - 1, 8).alias("chi2"), R(F.sum(F.abs(F.col("q") - 1 / F.col("m"))) / 2, 8).alias("tv"), R(m * F.min("q"), 8).alias("min_ratio"), F.count("*").alias("m"))


@query("clopper_pearson", None)
def clopper_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of customers in debt by nation, with its exact interval."""
    n = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.when(F.col("c_acctbal") < 0, 1)).alias("hits"), F.count("*").alias("n"))
    ends = estimates.clopper_pearson(F.col("hits"), F.col("n"))
    return n.withColumn("ends", ends).select("c_nationkey", "hits", "n", R("ends.low", 8).alias("low"), R("ends.high", 8).alias("high"))
