"""Queries that hold customers as funds, and their orders as mandates, against region rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemark.operators import regions
from rulemark.plans.registry import query
from rulemark.sources.tables import read

KNOWN, PROXIES = ["sector", "carbon", "flag:tobacco"], ["tobacco"]
_text = lambda v: "NULL" if v is None else str(v) if isinstance(v, (bool, float)) else "[" + ", ".join(f"'{x}'" for x in v) + "]::VARCHAR[]" if isinstance(v, list) else f"'{v}'"
FUNDS_SQL = f"""WITH rules AS (SELECT * FROM (VALUES {", ".join(f"({k}, {', '.join(map(_text, r))})" for k, r in enumerate(regions.RULES))}) AS v(rule_no, rule_id, region, applies_if, kind, lim, bound, about, needs, verified)),
    funds AS (SELECT c_custkey AS fund_id, CASE WHEN c_custkey % 2 = 0 THEN 'EU' ELSE 'US' END AS region, CASE c_custkey % 6 WHEN 0 THEN 'Green Fund' WHEN 1 THEN c_mktsegment WHEN 2 THEN 'Social Transition' WHEN 4 THEN 'Plain' END AS fund_name, c_custkey % 3 = 0 AS diversified, c_custkey % 8 = 0 AS claims_pab FROM customer),
    req AS (SELECT fund_id, r.* FROM funds f JOIN rules r USING (region) WHERE applies_if = 'always' OR (applies_if = 'diversified' AND diversified) OR (applies_if = 'claims_pab' AND claims_pab) OR (applies_if = 'name_focus' AND trim(coalesce(fund_name, '')) <> '')
        OR (applies_if = 'name_any' AND fund_name IN ('Green Fund', 'Social Transition')) OR (applies_if = 'name_pab' AND fund_name = 'Green Fund') OR (applies_if = 'name_ctb' AND fund_name = 'Social Transition'))"""


def funds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 6 == 0, "Green Fund").when(k % 6 == 1, F.col("c_mktsegment")).when(k % 6 == 2, "Social Transition").when(k % 6 == 4, "Plain")
    return read(spark, sf_dir, "customer").select(k.alias("fund_id"), F.when(k % 2 == 0, "EU").otherwise("US").alias("region"), name.alias("fund_name"), (k % 3 == 0).alias("diversified"), (k % 8 == 0).alias("claims_pab"))


@query("region_rules_applicable", FUNDS_SQL + f""" SELECT fund_id, rule_id, CASE WHEN len(list_filter(needs, lambda n: NOT list_contains({_text(KNOWN)}, n))) > 0 OR (kind IS NULL AND len(needs) > 0) THEN 'unobservable'
    WHEN len(list_filter(needs, lambda n: n = 'flag:tobacco')) > 0 THEN 'proxy' ELSE 'observable' END AS observability, CASE WHEN verified THEN 'disclosed' ELSE 'assumed' END AS status FROM req""")
def region_rules_applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that applies to a fund, and whether the universe's data can show it."""
    seen = regions.observability(F.col("needs"), F.col("kind"), KNOWN, PROXIES)
    return regions.applicable(funds(spark, sf_dir)).select("fund_id", "rule_id", seen.alias("observability"), F.when(F.col("verified"), "disclosed").otherwise("assumed").alias("status"))


@query("mandate_vs_region", FUNDS_SQL + f""", m AS (SELECT o_custkey AS fund_id, o_orderkey AS place, CASE o_orderkey % 5 WHEN 0 THEN 'position_cap' WHEN 1 THEN 'sector_cap' WHEN 2 THEN 'exclude' WHEN 3 THEN 'group_limit' ELSE 'portfolio_average' END AS kind, round(o_totalprice / 500000, 2) AS lim,
        CASE WHEN o_orderstatus = 'P' THEN 'count' ELSE 'weight' END AS unit, CASE WHEN o_orderkey % 5 = 3 AND o_orderkey % 2 = 0 THEN 'min' ELSE 'max' END AS bound, CASE o_orderkey % 5 WHEN 1 THEN '*' WHEN 2 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'Tobacco' ELSE 'coal_1pct' END ELSE 'Carbon' END AS about,
        CASE WHEN o_orderkey % 4 = 0 THEN 'absolute' ELSE '{regions.BASIS}' END AS basis FROM orders WHERE o_orderpriority <> '1-URGENT'),
    j AS (SELECT req.*, m.place, CASE WHEN req.kind = 'exclude' THEN true WHEN req.bound = 'min' THEN m.lim >= req.lim - {regions.NEAR} ELSE m.lim <= req.lim + {regions.NEAR} END AS ok FROM req LEFT JOIN m ON m.fund_id = req.fund_id AND m.kind = req.kind AND CASE req.kind WHEN 'position_cap' THEN true
        WHEN 'sector_cap' THEN m.unit = 'weight' AND m.about = '*' WHEN 'exclude' THEN lower(m.about) = lower(req.about) WHEN 'group_limit' THEN m.unit = 'weight' AND m.bound = 'min' ELSE lower(m.about) = req.about AND m.bound = req.bound AND m.basis = '{regions.BASIS}' END)
    SELECT fund_id, rule_no, rule_id, verified, CASE WHEN any_value(kind) IS NULL THEN 'not comparable' WHEN min(place) FILTER (ok) IS NOT NULL THEN 'at least as strict' WHEN max(place) FILTER (NOT ok) IS NOT NULL THEN 'weaker' ELSE 'silent' END AS verdict,
        'c' || coalesce(min(place) FILTER (ok), max(place) FILTER (NOT ok)) AS matched_constraint FROM j GROUP BY 1, 2, 3, 4""")
def mandate_vs_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each applicable rule against the fund's own constraints: as strict, weaker, silent or not comparable."""
    k = F.col("o_orderkey")
    kind = F.when(k % 5 == 0, "position_cap").when(k % 5 == 1, "sector_cap").when(k % 5 == 2, "exclude").when(k % 5 == 3, "group_limit").otherwise("portfolio_average")
    about = F.when(k % 5 == 1, "*").when(k % 5 == 2, F.when(k % 3 == 0, "Tobacco").otherwise("coal_1pct")).otherwise("Carbon")
    mandate = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("fund_id"), F.concat(F.lit("c"), k).alias("constraint_id"), k.alias("place"), F.when(F.col("o_orderpriority") == "1-URGENT", "regulatory").otherwise("hard").alias("constraint_type"), kind.alias("kind"), F.round(F.col("o_totalprice") / 500000, 2).alias("limit"),
        F.when(F.col("o_orderstatus") == "P", "count").otherwise("weight").alias("unit"), F.when((k % 5 == 3) & (k % 2 == 0), "min").otherwise("max").alias("bound"), F.array(about).alias("about"), F.when(k % 4 == 0, "absolute").otherwise(regions.BASIS).alias("basis"),
    )
    return regions.compared(regions.applicable(funds(spark, sf_dir)), mandate)
