"""Queries on rule specs compiled against all assets, and on every fund under them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemark.operators import spec as specs
from rulemark.plans.registry import query
from rulemark.sources.tables import assets, holdings, sql

K = 20
_SAID = {"source": "", "note": ""}
SPEC = {
    "fund_name": "Example",
    "rules": [
        {"kind": "holdings", "min": 15, "max": 25, **_SAID},
        {"kind": "position_cap", "max_weight": 0.1, **_SAID},
        {"kind": "sector_cap", "sector": "each", "limit": 0.4, "unit": "weight", **_SAID},
        {"kind": "exclude", "by": "country", "values": ["brand#13 ", "Brand#99"], **_SAID},
        {"kind": "exclude_threshold", "metric": "ESG", "side": "below", "value": 5.0, "basis": "percentile", "scope": "sector", **_SAID},
        {"kind": "group_limit", "by": "sector", "values": ["PROMO"], "bound": "min", "limit": 0.1, "unit": "weight", **_SAID},
        {"kind": "threshold_share", "metric": "carbon", "side": "above", "value": 1.0, "basis": "relative_to_mean", "scope": "universe", "bound": "max", "limit": 12, "unit": "names", **_SAID},
        {"kind": "portfolio_average", "metric": "esg", "bound": "min", "value": 50.0, "basis": "percentile", **_SAID},
        {"kind": "min_groups", "category": "sector", "min": 3, **_SAID},
        {"kind": "group_limit", "by": "theme", "values": ["water"], "bound": "max", "limit": 3, "unit": "names", **_SAID},
        {"kind": "exclude", "by": "country", "values": ["Nowhere"], **_SAID},
        {"kind": "unmapped", "reason": "engagement is not a number", **_SAID},
    ],
}
#: What each rule is about, and when a rule of the spec counts: the twin states it in SQL of its own.
FACTS_SQL = """, lv AS (SELECT sector, quantile_cont(esg, 0.05) AS low FROM assets GROUP BY 1), w AS (SELECT avg(carbon) AS mean_carbon, quantile_cont(esg, 0.5) AS mid_esg FROM assets),
    x AS (SELECT a.*, country = 'Brand#13' AS m3, esg < low AS m4, sector = 'PROMO' AS m5, carbon > mean_carbon AS m6, mid_esg FROM assets a LEFT JOIN lv USING (sector), w)"""


def _compiled(spark: SparkSession, sf_dir: str) -> list[specs.Compiled]:
    return specs.compile_spec(SPEC, specs.Universe(assets(spark, sf_dir), labels=("sector", "country"), numeric=("esg", "carbon")), K)[0]


@query("spec_compile_status", sql(FACTS_SQL + f""", c AS (SELECT count(*) FILTER (m3) AS c3, count(*) FILTER (m4) AS c4, count(*) FILTER (m5) AS c5, count(*) FILTER (m6) AS c6, count(DISTINCT sector) AS sectors FROM x)
    SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]) AS rule_no,
        unnest(['holdings', 'position_cap', 'sector_cap', 'exclude', 'exclude_threshold', 'group_limit', 'threshold_share', 'portfolio_average', 'min_groups', 'group_limit', 'exclude', 'unmapped']) AS kind,
        unnest(['mapped', 'trivial', 'mapped', CASE WHEN c3 = 0 THEN 'unmapped' ELSE 'mapped' END, CASE WHEN c4 = 0 THEN 'trivial' ELSE 'mapped' END, 'mapped', CASE WHEN 12 >= least({K}, c6) THEN 'trivial' ELSE 'mapped' END, 'mapped', 'mapped', 'unmapped', 'unmapped', 'unmapped']) AS status,
        unnest([NULL, NULL, NULL, c3, c4, c5, c6, NULL, NULL, NULL, NULL, NULL]) AS members,
        unnest([1, 0, CAST(sectors AS INT), CASE WHEN c3 = 0 THEN 0 ELSE 1 END, CASE WHEN c4 = 0 THEN 0 ELSE 1 END, 1, CASE WHEN 12 >= least({K}, c6) THEN 0 ELSE 1 END, 1, 1, 0, 0, 0]) AS predicates FROM c""", "assets"))
def spec_compile_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule of a spec against all assets: whether it maps to predicates, and how many assets it is about."""
    rows = [(i, c.rule["kind"], c.status, c.members, len(c.rules)) for i, c in enumerate(_compiled(spark, sf_dir))]
    return spark.createDataFrame(rows, "rule_no int, kind string, status string, members long, predicates int")


@query("spec_fund_compliance", sql(FACTS_SQL + f""", d AS (SELECT fund_id, max(report_date) AS d FROM holdings GROUP BY 1),
    h AS (SELECT h.fund_id, x.* FROM holdings h JOIN d ON h.fund_id = d.fund_id AND h.report_date = d.d JOIN x USING (asset_id)),
    s AS (SELECT fund_id, max(n) AS n FROM (SELECT fund_id, sector, count(*) AS n FROM h GROUP BY 1, 2) GROUP BY 1),
    f AS (SELECT fund_id, count(*) AS n, any_value(s.n) AS most, count(*) FILTER (m3) AS n3, count(*) FILTER (m4) AS n4, count(*) FILTER (m5) AS n5, count(*) FILTER (m6) AS n6, avg(esg) AS esg, any_value(mid_esg) AS mid_esg, count(DISTINCT sector) AS sectors FROM h JOIN s USING (fund_id) GROUP BY 1)
    SELECT fund_id, 0 AS rule_no, 'holdings' AS kind, n = {K} AS ok FROM f UNION ALL SELECT fund_id, 2, 'sector_cap', most <= 8 FROM f
    UNION ALL SELECT fund_id, 3, 'exclude', n3 = 0 FROM f WHERE (SELECT count(*) FILTER (m3) > 0 FROM x)
    UNION ALL SELECT fund_id, 4, 'exclude_threshold', n4 = 0 FROM f WHERE (SELECT count(*) FILTER (m4) > 0 FROM x)
    UNION ALL SELECT fund_id, 5, 'group_limit', n5 >= 2 FROM f UNION ALL SELECT fund_id, 6, 'threshold_share', n6 <= 12 FROM f WHERE (SELECT count(*) FILTER (m6) > 12 FROM x)
    UNION ALL SELECT fund_id, 7, 'portfolio_average', esg >= mid_esg FROM f UNION ALL SELECT fund_id, 8, 'min_groups', sectors >= 3 FROM f""", "holdings", "assets"))
def spec_fund_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fund's last holdings under the mapped rules of the spec."""
    h = holdings(spark, sf_dir).select("fund_id", "report_date", "asset_id")
    last = h.groupBy("fund_id").agg(F.max("report_date").alias("report_date"))
    held = h.join(last, ["fund_id", "report_date"]).join(assets(spark, sf_dir), "asset_id")
    return specs.obeys(held, _compiled(spark, sf_dir), "fund_id")
