"""Queries on exact extremes of portfolios under rules, and on rules that contradict each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemark.operators import extremes
from rulemark.operators.extremes import Linear, Shape
from rulemark.plans.registry import query
from rulemark.sources.tables import read

#: Portfolios of a nation's market segments in twentieths.
NATION = Shape(units=20, k_min=3, k_max=5)
LOW, HIGH = 2, 9
#: Least mean share of customers in debt (per mille), least weight of two segments, least count of three.
LOAD, HEAVY, BROAD = 95, 11, 2
NAMES_SQL = """c AS (SELECT n_nationkey AS nation, n_regionkey AS region, c_mktsegment AS segment, CAST(round(c_acctbal * 100) AS BIGINT) AS cents, c_acctbal < 0 AS debt FROM customer JOIN nation ON c_nationkey = n_nationkey),
    names AS (SELECT nation, segment AS name, CAST(floor(sum(cents)::DOUBLE / count(*)) AS BIGINT) AS value, CAST(floor(1000 * count(*) FILTER (debt)::DOUBLE / count(*)) AS BIGINT) AS load FROM c GROUP BY 1, 2)"""
POINTS_SQL = f"""o AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY value, name) AS i, count(*) OVER (PARTITION BY nation) AS n FROM names),
    q AS (SELECT 0 AS q UNION ALL SELECT unnest(range({LOW}, {HIGH + 1}))),
    g AS (
        SELECT nation, 0::BIGINT AS i, {NATION.units} AS left_, 0 AS held, 0::BIGINT AS total, 0::BIGINT AS load, 0 AS heavy, 0 AS broad, CAST([] AS INT[]) AS point FROM (SELECT DISTINCT nation FROM o)
        UNION ALL
        SELECT g.nation, o.i, left_ - q, held + (q > 0)::INT, total + value * q, g.load + o.load * q, heavy + CASE WHEN name IN ('BUILDING', 'MACHINERY') THEN q ELSE 0 END,
            broad + (name NOT IN ('BUILDING', 'MACHINERY') AND q > 0)::INT, list_append(point, q) FROM g JOIN o ON o.nation = g.nation AND o.i = g.i + 1 JOIN q ON q <= left_
    ), p AS (SELECT g.* FROM g JOIN (SELECT nation, max(n) AS n FROM o GROUP BY 1) AS m ON m.nation = g.nation AND m.n = g.i WHERE left_ = 0 AND held BETWEEN {NATION.k_min} AND {NATION.k_max})"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nation, region, name, value, load, low, high): a nation's market segments, their mean balance in cents and customers in debt per mille."""
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    rows = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("name"), "c_acctbal")
    of = rows.groupBy("nation", "name").agg(F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"), F.count_if(F.col("c_acctbal") < 0).alias("debt"), F.count("*").alias("n"))
    value, load = F.floor(F.col("cents").cast("double") / F.col("n")), F.floor(1000 * F.col("debt").cast("double") / F.col("n"))
    return of.join(nation, "nation").select("nation", "region", "name", value.alias("value"), load.alias("load"), F.lit(LOW).alias("low"), F.lit(HIGH).alias("high"))


def _rules(load: Column | int, heavy: Column | int, broad: Column | int) -> list[Linear]:
    two = F.col("name").isin("BUILDING", "MACHINERY").cast("long")
    return [
        Linear("load", per_unit=F.col("load") - load, high=0),
        Linear("heavy", per_unit=two, high=heavy),
        Linear("broad", per_name=1 - two, low=broad),
    ]


def _shown(column: str) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws("=", s["name"], s["units"])), ",").alias(column)


@query("portfolio_extremes", f"""WITH RECURSIVE {NAMES_SQL}, {POINTS_SQL},
    f AS (SELECT * FROM p WHERE load - {LOAD} * {NATION.units} <= 0 AND heavy <= {HEAVY} AND broad >= {BROAD}),
    e AS (SELECT nation, min({{'v': total, 'p': point}}) AS lo, max({{'v': total, 'p': point}}) AS hi FROM f GROUP BY 1),
    w AS (SELECT o.nation, string_agg(name || '=' || lo.p[i], ',' ORDER BY name) FILTER (lo.p[i] > 0) AS argmin, string_agg(name || '=' || hi.p[i], ',' ORDER BY name) FILTER (hi.p[i] > 0) AS argmax FROM o JOIN e USING (nation) GROUP BY 1)
    SELECT d.nation, lo IS NOT NULL AS feasible, lo.v AS lowest, hi.v AS highest, coalesce(argmin, '') AS argmin, coalesce(argmax, '') AS argmax FROM (SELECT DISTINCT nation FROM names) AS d LEFT JOIN e USING (nation) LEFT JOIN w USING (nation)""")
def portfolio_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every nation the least and greatest value of a portfolio of its segments that obeys three rules."""
    found = extremes.extremes(_names(spark, sf_dir), ["nation"], _rules(LOAD, HEAVY, BROAD), NATION)
    return found.select("nation", "feasible", "lowest", "highest", F.coalesce(_shown("argmin"), F.lit("")).alias("argmin"), F.coalesce(_shown("argmax"), F.lit("")).alias("argmax"))


#: All regions by segments as the names of one portfolio; no region may hold more than REGION_MOST units.
WORLD, WORLD_LOW, WORLD_HIGH, REGION_MOST = Shape(units=20, k_min=5, k_max=8), 2, 5, 7


@query("portfolio_extremes_world", f"""WITH RECURSIVE {NAMES_SQL}, w AS (SELECT region, segment, CAST(floor(sum(cents)::DOUBLE / count(*)) AS BIGINT) AS value FROM c GROUP BY 1, 2),
    o AS (SELECT *, row_number() OVER (ORDER BY value, region, segment) AS i FROM w), q AS (SELECT 0 AS q UNION ALL SELECT unnest(range({WORLD_LOW}, {WORLD_HIGH + 1}))),
    g AS (
        SELECT 0::BIGINT AS i, {WORLD.units} AS left_, 0 AS held, [0, 0, 0, 0, 0] AS by_region, 0::BIGINT AS lowest, 0::BIGINT AS highest
        UNION ALL
        (WITH s AS (SELECT o.i, left_ - q AS left_, held + (q > 0)::INT AS held, list_transform(by_region, lambda x, j: x + CASE WHEN j = region + 1 THEN q ELSE 0 END) AS by_region, lowest + value * q AS lowest, highest + value * q AS highest FROM g JOIN o ON o.i = g.i + 1 JOIN q ON q <= left_)
        SELECT i, left_, held, by_region, min(lowest), max(highest) FROM s WHERE held <= {WORLD.k_max} AND list_max(by_region) <= {REGION_MOST} GROUP BY ALL)
    ) SELECT min(lowest) AS lowest, max(highest) AS highest FROM g WHERE i = (SELECT count(*) FROM o) AND left_ = 0 AND held >= {WORLD.k_min}""")
def portfolio_extremes_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least and greatest value over all regions by segments at once; a first search by a narrow beam gives values to beat."""
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"))
    rows = read(spark, sf_dir, "customer").join(nation, "c_nationkey").groupBy("region", "c_mktsegment").agg(F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"), F.count("*").alias("n"))
    names = rows.select(F.lit("world").alias("case"), "region", F.struct("region", "c_mktsegment").alias("name"), F.floor(F.col("cents").cast("double") / F.col("n")).alias("value"), F.lit(WORLD_LOW).alias("low"), F.lit(WORLD_HIGH).alias("high"))
    rules = [Linear(f"region {r}", per_unit=(F.col("region") == r).cast("long"), high=REGION_MOST) for r in range(5)]
    return extremes.extremes(names, ["case"], rules, WORLD, beam=200).select("lowest", "highest")


#: Bounds that depend on the nation, so that some nations' rules contradict each other.
TIGHT_LOAD, TIGHT_HEAVY, TIGHT_BROAD = "CASE WHEN nation % 3 = 0 THEN 40 ELSE 95 END", "CASE WHEN nation % 4 = 0 THEN 1 ELSE 11 END", "CASE WHEN nation % 4 = 0 THEN 2 WHEN nation % 5 = 0 THEN 3 ELSE 1 END"
#: The heavy segments must also hold a least weight, which contradicts their cap in some nations.
TRIED_SQL = f"""t AS (SELECT nation, load <= ({TIGHT_LOAD}) * {NATION.units} AS load, heavy <= ({TIGHT_HEAVY}) AS heavy, broad >= ({TIGHT_BROAD}) AS broad, heavy >= 2 AS floor FROM p)"""
RULE_NAMES = ("load", "heavy", "broad", "floor")


def _tight() -> list[Linear]:
    two = F.col("name").isin("BUILDING", "MACHINERY").cast("long")
    return [*_rules(F.expr(TIGHT_LOAD), F.expr(TIGHT_HEAVY), F.expr(TIGHT_BROAD)), Linear("floor", per_unit=two, low=2)]


@query("infeasible_rules", f"""WITH RECURSIVE {NAMES_SQL}, {POINTS_SQL}, {TRIED_SQL},
    f AS (SELECT nation, bool_or(load AND heavy AND broad AND floor) AS feasible, {', '.join(f"bool_or({' AND '.join(r for r in RULE_NAMES if r != n)}) AS no_{n}" for n in RULE_NAMES)} FROM t GROUP BY 1)
    SELECT d.nation, coalesce(feasible, false) AS feasible, CASE WHEN feasible THEN '' ELSE array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN no_{n} THEN '{n}' END" for n in RULE_NAMES)}], lambda x: x IS NOT NULL)), ',') END AS relief
    FROM (SELECT DISTINCT nation FROM names) AS d LEFT JOIN f USING (nation)""")
def infeasible_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every nation whether its rules can be obeyed, else the rules each of which alone stands in the way."""
    found = extremes.diagnose(_names(spark, sf_dir), ["nation"], _tight(), NATION)
    return found.select("nation", "feasible", F.array_join("relief", ",").alias("relief"))


# A set of rules contradicts itself if no point obeys all of them; the filter goes through the rules in order.
_BIT = " + ".join(f"{1 << k} * {n}::INT" for k, n in enumerate(RULE_NAMES))


@query("rule_contradictions", f"""WITH RECURSIVE {NAMES_SQL}, {POINTS_SQL}, {TRIED_SQL}, b AS (SELECT nation, {_BIT} AS obeyed FROM t),
    s AS (SELECT d.nation, m, count(*) FILTER (obeyed & m = m) > 0 AS fine FROM (SELECT DISTINCT nation FROM names) AS d CROSS JOIN range(16) AS r(m) LEFT JOIN b USING (nation) GROUP BY 1, 2),
    k AS (SELECT nation, 0 AS step, 15::BIGINT AS m FROM s WHERE m = 15 AND NOT fine UNION ALL SELECT k.nation, step + 1, CASE WHEN s.fine THEN k.m ELSE s.m END FROM k JOIN s ON s.nation = k.nation AND s.m = k.m & ~(1 << step) WHERE step < 4)
    SELECT nation, array_to_string(list_filter([{', '.join(f"CASE WHEN m & {1 << k} > 0 THEN '{n}' END" for k, n in enumerate(RULE_NAMES))}], lambda x: x IS NOT NULL), ',') AS conflict FROM k WHERE step = 4""")
def rule_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every nation whose rules cannot be obeyed, a contradiction from which no rule can be spared."""
    return extremes.contradiction(_names(spark, sf_dir), ["nation"], _tight(), NATION).select("nation", F.array_join("conflict", ",").alias("conflict"))
