"""Queries on the repair of sampled portfolios that break selection rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemark.operators import repair
from rulemark.operators.repair import Average
from rulemark.plans.portfolio import K, M, SAMPLES_SQL, samples, universe_assets
from rulemark.plans.registry import query
from rulemark.sources.tables import sql

PROMO, ECONOMY, ESG = 1, 2, 30.0
_V = f"""round(@b + abs(@n - {K}) / {K}::DOUBLE + greatest(@p - {PROMO}, 0) / {PROMO}::DOUBLE + greatest(@e - {ECONOMY}, 0) / {ECONOMY}::DOUBLE
    + CASE WHEN @n > 0 THEN greatest({ESG} - @x / @n, 0) / escale ELSE 1 END + CASE WHEN @n > 0 THEN greatest(@y / @n - most, 0) / cscale ELSE 1 END, 9)"""


def _violation(**of: str) -> str:
    out = _V
    for k, v in of.items():
        out = out.replace(f"@{k}", f"({v})")
    return out


#: Every third sample loses names, so is short of K; rounds make the least move of all of the universe's names.
REPAIR_SQL = SAMPLES_SQL + f""", l AS (SELECT max(esg) - min(esg) AS escale, max(carbon) - min(carbon) AS cscale, round(avg(carbon), 2) AS most FROM small),
    u AS (SELECT asset_id AS a, (sector = 'PROMO')::INT AS p, (sector = 'ECONOMY')::INT AS e, (country = 'Brand#13')::INT AS b, esg AS x, carbon AS y FROM small),
    h AS (SELECT sample_id, list(a ORDER BY a) AS names, count(*) AS n, sum(p) AS p, sum(e) AS e, sum(b) AS b, sum(x) AS x, sum(y) AS y FROM s JOIN u ON a = asset_id WHERE sample_id % 3 <> 0 OR asset_id % 5 <> 0 GROUP BY 1),
    st AS (
        SELECT sample_id, 0 AS step, names, CAST(n AS BIGINT) AS n, CAST(p AS BIGINT) AS p, CAST(e AS BIGINT) AS e, CAST(b AS BIGINT) AS b, x, y, {_violation(n='n', p='p', e='e', b='b', x='x', y='y')} AS v FROM h, l
        UNION ALL
        (WITH o AS (SELECT sample_id, step, names, st.n, st.p, st.e, st.b, st.x, st.y, v, i.a AS into_, coalesce(i.p, 0) AS ip, coalesce(i.e, 0) AS ie, coalesce(i.b, 0) AS ib, coalesce(i.x, 0) AS ix, coalesce(i.y, 0) AS iy
                FROM st LEFT JOIN u AS i ON st.n <= {K} AND NOT list_contains(names, i.a) WHERE v > 0),
        w AS (SELECT o.*, g.a AS out_, o.n + (into_ IS NOT NULL)::INT - (g.a IS NOT NULL)::INT AS n1, o.p + ip - coalesce(g.p, 0) AS p1, o.e + ie - coalesce(g.e, 0) AS e1, o.b + ib - coalesce(g.b, 0) AS b1, o.x + ix - coalesce(g.x, 0) AS x1, o.y + iy - coalesce(g.y, 0) AS y1
                FROM o LEFT JOIN u AS g ON o.n >= {K} AND list_contains(names, g.a)),
        m AS (SELECT sample_id, any_value(n) AS was, any_value(v) AS before, min({{'v': {_violation(n='n1', p='p1', e='e1', b='b1', x='x1', y='y1')}, 'x': -ix, 'y': iy, 'into': into_, 'out': out_}}) AS move FROM w, l GROUP BY 1)
        SELECT DISTINCT w.sample_id, step + 1, CASE WHEN into_ IS NULL THEN list_filter(names, lambda z: z <> out_) ELSE list_append(list_filter(names, lambda z: out_ IS NULL OR z <> out_), into_) END, CAST(n1 AS BIGINT), CAST(p1 AS BIGINT), CAST(e1 AS BIGINT), CAST(b1 AS BIGINT), x1, y1, move.v
        FROM w JOIN m ON m.sample_id = w.sample_id AND move.into IS NOT DISTINCT FROM into_ AND move.out IS NOT DISTINCT FROM out_ WHERE was <> {K} OR move.v < before)
    ), z AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY step DESC) AS r, first(v) OVER (PARTITION BY sample_id ORDER BY step) AS v0, first(names) OVER (PARTITION BY sample_id ORDER BY step) AS names0 FROM st),
    fin AS (SELECT sample_id, v0, CASE WHEN v = 0 THEN 0 ELSE v0 END AS v1, step, CASE WHEN v0 = 0 THEN 'kept' WHEN v = 0 THEN 'repaired' ELSE 'failed' END AS outcome, CASE WHEN v = 0 THEN names ELSE names0 END AS names FROM z WHERE r = 1)"""


def _repaired(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    universe = universe_assets(spark, sf_dir)
    most = universe.agg(F.round(F.avg("carbon"), 2)).first()[0]
    rules = repair.Rules(
        k=K, caps={"promo": (F.col("sector") == "PROMO", PROMO), "economy": (F.col("sector") == "ECONOMY", ECONOMY)}, banned=F.col("country") == "Brand#13",
        averages=(Average("esg", ESG), Average("carbon", most, at_least=False)),
    )
    held = samples(spark, sf_dir).select("sample_id", "asset_id").where("sample_id % 3 <> 0 OR asset_id % 5 <> 0")
    return repair.repair(held, universe.select("asset_id", "sector", "country", "esg", "carbon"), rules, samples=spark.range(M).select(F.col("id").alias("sample_id")))


def _recursive(query_sql: str) -> str:
    return query_sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("repair_report", _recursive(sql(REPAIR_SQL + " SELECT sample_id, round(v0, 6) AS before, round(v1, 6) AS after, step AS steps, outcome FROM fin", "assets")))
def repair_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every sampled portfolio how far it missed the rules, and what repair came to in how many moves."""
    report = _repaired(spark, sf_dir)[1]
    return report.select("sample_id", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "steps", "outcome")


@query("repaired_portfolios", _recursive(sql(REPAIR_SQL + " SELECT sample_id, unnest(names) AS asset_id FROM fin", "assets")))
def repaired_portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of every portfolio after repair."""
    return _repaired(spark, sf_dir)[0].select("sample_id", "asset_id")
