"""Rules that a region sets for funds, who they apply to, and how a fund's own mandate compares.

The rule table has a row a rule (below thirty), so it is the broadcast side of every
join here; mandates are aggregated by fund and rule and never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemark.functions.text import name_categories

# Rule, region, when it applies, kind of limit, its number, bound, what it is about, data it needs, whether its text was verified.
RULES = (
    ("us_names_rule_80", "US", "name_focus", "group_limit", 0.8, "min", "in_name_focus", ["flag:in_name_focus"], True),
    ("us_diversified_75_5", "US", "diversified", None, None, None, None, [], False),
    ("us_concentration_25", "US", "always", "sector_cap", 0.25, "max", "*", ["sector"], False),
    ("us_ric_issuer_25", "US", "always", "position_cap", 0.25, "max", None, [], False),
    ("eu_name_80", "EU", "name_any", "group_limit", 0.8, "min", "meets_binding_elements", ["flag:meets_binding_elements"], True),
    ("eu_excl_controversial_weapons", "EU", "name_any", "exclude", None, None, "controversial_weapons", ["flag:controversial_weapons"], False),
    ("eu_excl_tobacco", "EU", "name_any", "exclude", None, None, "tobacco", ["flag:tobacco"], False),
    ("eu_excl_ungc_violation", "EU", "name_any", "exclude", None, None, "ungc_violation", ["flag:ungc_violation"], False),
    ("eu_excl_coal_1pct", "EU", "name_pab", "exclude", None, None, "coal_1pct", ["flag:coal_1pct"], False),
    ("eu_excl_oil_10pct", "EU", "name_pab", "exclude", None, None, "oil_10pct", ["flag:oil_10pct"], False),
    ("eu_excl_gas_50pct", "EU", "name_pab", "exclude", None, None, "gas_50pct", ["flag:gas_50pct"], False),
    ("eu_excl_high_carbon_power_50pct", "EU", "name_pab", "exclude", None, None, "high_carbon_power_50pct", ["flag:high_carbon_power_50pct"], False),
    ("eu_pab_intensity_50", "EU", "claims_pab", "portfolio_average", 0.5, "max", "carbon", ["carbon"], False),
    ("eu_pab_decarbonisation_7", "EU", "claims_pab", None, None, None, None, ["carbon"], False),
)
SCHEMA = "rule_id string, region string, applies_if string, kind string, limit double, bound string, about string, needs array<string>, verified boolean"
BASIS, NEAR = "relative_to_mean", 1e-12


def rules(spark: SparkSession) -> DataFrame:
    """The table of rules with their place in it (``rule_no``)."""
    return spark.createDataFrame([(k, *r) for k, r in enumerate(RULES)], f"rule_no int, {SCHEMA}")


def applicable(funds: DataFrame, region: str = "region", name: str = "fund_name", diversified: str = "diversified", claims_pab: str = "claims_pab") -> DataFrame:
    """funds with every rule that applies to them; a region other than US or EU raises, a null name has no words."""
    known = F.when(F.col(region).isin("US", "EU"), F.col(region)).otherwise(F.raise_error(F.concat(F.lit("region is US or EU, not "), F.coalesce(F.col(region), F.lit("null")))).cast("string"))
    text = F.coalesce(F.col(name), F.lit(""))
    words = F.when(known == "EU", name_categories(text)).otherwise(F.when(F.trim(text) != "", F.array(F.lit("name_focus"))).otherwise(F.array().cast("array<string>")))
    on = F.concat(F.array(F.lit("always")), F.when(F.col(diversified), F.array(F.lit("diversified"))).otherwise(F.array().cast("array<string>")), F.when(F.col(claims_pab), F.array(F.lit("claims_pab"))).otherwise(F.array().cast("array<string>")), words)
    table = F.broadcast(rules(funds.sparkSession).withColumnRenamed("region", "_region"))  # the fixed table
    return funds.withColumns({"_on": on, region: known}).join(table, (F.col(region) == F.col("_region")) & F.array_contains("_on", F.col("applies_if"))).drop("_on", "_region")


def observability(needs: Column, kind: Column, known: list[str], proxies: list[str] | None = None) -> Column:
    """unobservable where data that a rule needs are missing (or it needs data and has no executable form), proxy where they are a stand-in."""
    has, stand_in = F.array(*map(F.lit, known)).cast("array<string>"), F.array(*map(F.lit, proxies or [])).cast("array<string>")
    missing = F.exists(needs, lambda n: ~F.array_contains(has, n))
    proxy = F.exists(needs, lambda n: F.array_contains(stand_in, n) | F.array_contains(stand_in, F.regexp_replace(n, "^flag:", "")))
    return F.when(missing | (kind.isNull() & (F.size(needs) > 0)), "unobservable").when(proxy, "proxy").otherwise("observable")


def compared(required: DataFrame, mandate: DataFrame, fund: str = "fund_id") -> DataFrame:
    """Each rule of ``required`` (``applicable``) with a verdict on the fund's own mandate and the constraint that decided it.

    mandate: (fund, constraint_id, place, constraint_type, kind, limit, unit, bound, about,
    basis), ``about`` an array of names. Regulatory entries are not the fund's own.
    The first entry by place that is strict enough decides; else the last looser one
    ("weaker"); none of the kind is "silent", a rule without a number "not comparable".
    """
    m, r = (lambda c: F.col(f"_m.{c}")), F.col
    own = mandate.where(F.col("constraint_type") != "regulatory").select(F.col(fund).alias("_fund"), F.col("kind").alias("_kind"), F.struct("constraint_id", "place", "limit", "unit", "bound", "about", "basis").alias("_m"))
    lower = F.transform(m("about"), F.lower)
    weight = m("unit") == "weight"
    same = (
        F.when(r("kind") == "position_cap", F.lit(True))
        .when(r("kind") == "sector_cap", weight & F.trim(F.coalesce(F.get(m("about"), F.lit(0)), F.lit(""))).isin("", "*"))
        .when(r("kind") == "exclude", F.array_contains(lower, F.lower(r("about"))))
        .when(r("kind") == "group_limit", weight & (m("bound") == "min"))
        .when(r("kind") == "portfolio_average", F.array_contains(lower, r("about")) & (m("bound") == r("bound")) & (m("basis") == BASIS))
    )
    strict = F.when(r("kind") == "exclude", F.lit(True)).when(r("bound") == "min", m("limit") >= r("limit") - NEAR).otherwise(m("limit") <= r("limit") + NEAR)
    joined = required.join(own, (F.col(fund) == F.col("_fund")) & (F.col("kind") == F.col("_kind")) & same, "left").withColumn("_ok", strict)
    first = F.min_by(F.when(F.col("_ok"), m("constraint_id")), F.when(F.col("_ok"), m("place")))
    last = F.max_by(F.when(~F.col("_ok"), m("constraint_id")), F.when(~F.col("_ok"), m("place")))
    found = joined.groupBy(fund, "rule_no", "rule_id", "kind", "verified").agg(first.alias("_first"), last.alias("_last"))
    verdict = F.when(F.col("kind").isNull(), "not comparable").when(F.col("_first").isNotNull(), "at least as strict").when(F.col("_last").isNotNull(), "weaker").otherwise("silent")
    return found.select(fund, "rule_no", "rule_id", "verified", verdict.alias("verdict"), F.coalesce("_first", "_last").alias("matched_constraint"))
