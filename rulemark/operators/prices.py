"""Implied prices, returns between snapshots, and holding changes.

Three split detectors exist side by side, as their users differ: the implied
return ladder (nearest ratio), the change detector (tight ratio and price band)
and the forward-only detector of the skill table (largest fitting factor).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Share ratios of stock splits.
LADDER_RATIOS = (2.0, 3.0, 4.0, 5.0, 10.0, 20.0, 0.5, 1 / 3, 0.25, 0.2, 0.1, 0.05)
CHANGE_RATIOS = (1.5, 2.0, 3.0, 4.0, 5.0, 10.0, 20.0, 0.5, 1 / 3, 0.25, 0.2, 0.1, 0.05)
FORWARD_FACTORS = (2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 15.0, 20.0, 25.0, 30.0, 50.0)

#: What ``paired`` knows of both dates.
SIDES = ("balance0", "value0", "has0", "balance1", "value1", "has1")


def equity_sleeve(holdings: DataFrame, asset_category: str = "asset_category", payoff: str = "payoff_profile", units: str = "units", balance: str = "balance", value: str = "value_usd", group: list[str] | None = None) -> DataFrame:
    """Long common equity counted in shares, with its weight in the sleeve."""
    kept = holdings.where((F.col(asset_category) == "EC") & (F.col(payoff) == "Long") & (F.col(units) == "NS") & (F.col(balance) > 0) & (F.col(value) > 0))
    return kept.withColumn("weight", F.col(value) / F.sum(value).over(Window.partitionBy(*(group or []))))


def keyed(rows: DataFrame, keys: list[str], balance: str = "balance", value: str = "value") -> DataFrame:
    """Rows of one security added up; an all-null group stays null."""
    return rows.groupBy(*keys).agg(F.sum(balance).alias(balance), F.sum(value).alias(value), F.count("*").alias("n_rows"))


def consecutive(rows: DataFrame, group: list[str], date: str = "report_date") -> DataFrame:
    """(group, date, next_date): each date of a group with the one after it."""
    dates = rows.select(*group, date).distinct()
    return dates.withColumn("next_date", F.lead(date).over(Window.partitionBy(*group).orderBy(date))).where(F.col("next_date").isNotNull())


def paired(rows: DataFrame, group: list[str], key: str = "asset_id", date: str = "report_date", how: str = "inner") -> DataFrame:
    """Positions of a key at consecutive dates side by side (balance0, value0, balance1, value1).

    rows has one row a group, key and date; a null key meets nothing. With how="full"
    a key held at one of the dates only has nulls at the other. A key's rows are
    sorted once and looked at with their neighbours; rows are not joined with themselves.
    """
    near = Window.partitionBy(*group).orderBy(date)
    dates = rows.select(*group, date).distinct().withColumns({"_before": F.lag(date).over(near), "_after": F.lead(date).over(near)})
    along = Window.partitionBy(*group, key).orderBy(date)
    a = rows.join(dates, [*group, date]).withColumn("_next", F.lead(F.struct(F.col(date).alias("d"), "balance", "value")).over(along))
    met = F.col(key).isNotNull() & (F.col("_next.d") == F.col("_after"))
    later = lambda c: F.when(met, F.col(f"_next.{c}"))
    first = F.struct(F.col(date).alias("start"), F.col("_after").alias("end"), F.col("balance").alias("balance0"), F.col("value").alias("value0"), F.lit(True).alias("has0"), later("balance").alias("balance1"), later("value").alias("value1"), F.when(met, F.lit(True)).alias("has1"))
    if how == "inner":
        return a.where(met).select(first.alias("_pair"), *group, key).select(*group, "_pair.start", "_pair.end", key, *(f"_pair.{c}" for c in SIDES))
    if how != "full":
        raise ValueError(f"how is inner or full, not {how}")
    came = F.coalesce(F.lag(date).over(along) != F.col("_before"), F.lit(True)) | F.col(key).isNull()
    nothing = lambda c: F.lit(None).cast(rows.schema[c].dataType)
    last = F.struct(F.col("_before").alias("start"), F.col(date).alias("end"), nothing("balance").alias("balance0"), nothing("value").alias("value0"), F.lit(None).cast("boolean").alias("has0"), F.col("balance").alias("balance1"), F.col("value").alias("value1"), F.lit(True).alias("has1"))
    a = a.withColumn("_came", came)
    pairs = F.array_compact(F.array(F.when(F.col("_after").isNotNull(), first), F.when(F.col("_before").isNotNull() & F.col("_came"), last)))
    return a.select(*group, key, F.explode(pairs).alias("_pair")).select(*group, "_pair.start", "_pair.end", key, *(f"_pair.{c}" for c in SIDES))


def nearest_ratio(ratio: Column, ratios: tuple[float, ...] = LADDER_RATIOS) -> Column:
    """The listed ratio of the smallest |ln(ratio / r)|; the first of equals."""
    scored = F.array(*(F.struct(F.round(F.abs(F.ln(ratio / r)), 12).alias("d"), F.lit(k).alias("k"), F.lit(r).alias("r")) for k, r in enumerate(ratios)))
    return F.array_min(scored)["r"]


def implied_returns(pairs: DataFrame, passive_by: list[str] | None = None, plain: bool = True) -> DataFrame:
    """The implied return ladder on paired positions: ret, status, split_adjusted, share_count_changed.

    ``passive_by``: columns of the cross-section whose median share ratio (fund
    flow) is taken out; None marks an active source, whose share counts may move
    for trading, so only unchanged counts give a return.
    """
    a = pairs.withColumn("ratio", F.try_divide("balance1", "balance0")).withColumn("gross", F.try_divide(F.try_divide("value1", "balance1"), F.try_divide("value0", "balance0")))
    if passive_by is not None:
        medians = a.groupBy(*passive_by).agg(F.percentile("ratio", F.lit(0.5)).alias("flow"))
        a = a.join(medians, passive_by, "left").withColumn("ratio", F.try_divide("ratio", "flow")).drop("flow")
    a = a.withColumn("split", F.when(F.col("ratio") > 0, nearest_ratio(F.col("ratio"))))
    steady = F.abs(F.col("ratio") - 1) <= 0.08
    adjusted = F.col("gross") * F.col("split")
    split = F.lit(passive_by is not None) & (F.abs(F.col("ratio") / F.col("split") - 1) <= 0.15) & adjusted.between(0.5, 1.6)
    changed = F.lit(passive_by is not None and plain) & F.col("gross").between(0.4, 2.5)
    known = F.col("gross").isNotNull() & F.col("ratio").isNotNull()
    status = F.when(~known, "unknown").when(steady | split, "derived").when(changed, "assumed").otherwise("unknown")
    ret = F.when(known & steady, F.col("gross") - 1).when(known & split, adjusted - 1).when(known & changed, F.col("gross") - 1)
    return a.withColumns({"ret": ret, "status": status, "split_adjusted": F.coalesce(known & ~steady & split, F.lit(False)), "share_count_changed": F.coalesce(known & ~steady & ~split & changed, F.lit(False))})


def forward_split(price_ratio: Column, share_ratio: Column) -> Column:
    """The price ratio times the largest forward split factor that fits both ratios."""
    share = F.when(share_ratio > 0, share_ratio).otherwise(1.0)
    share = F.coalesce(share, F.lit(1.0))
    fits = F.array(*(F.when((price_ratio * f).between(0.75, 1.30) & (share >= 0.45 * f + 0.5), F.lit(f)) for f in FORWARD_FACTORS))
    return price_ratio * F.coalesce(F.array_max(fits), F.lit(1.0))


def holding_changes(pairs: DataFrame, group: list[str], net_flow: Column | None = None) -> DataFrame:
    """Changes between paired snapshots (``paired`` with how="full").

    An absent side is a zero position, a present position without a number stays
    null. Adds weights, the split-free share ratio, implied return, drift weight
    and active change (active_weight), the kind of change.
    """
    by = Window.partitionBy(*group)
    zero = lambda side, c: F.when(F.col(f"has{side}").isNull(), 0.0).otherwise(F.col(f"{c}{side}"))
    a = pairs.select(*[c for c in pairs.columns if c not in ("balance0", "value0", "balance1", "value1")], *(zero(s, c).alias(f"{c}{s}") for c in ("balance", "value") for s in (0, 1)))
    share = lambda s: F.when(F.col(f"has{s}").isNull(), 0.0).otherwise(F.try_divide(F.col(f"value{s}"), F.sum(f"value{s}").over(by)))
    a = a.withColumns({"w0": share(0), "w1": share(1)})
    ratio = F.when((F.col("balance0") > 0) & (F.col("balance1") > 0), F.col("balance1") / F.col("balance0"))
    price = F.when((F.col("balance0") > 0) & (F.col("balance1") > 0), F.try_divide(F.col("value1") / F.col("balance1"), F.col("value0") / F.col("balance0")))
    a = a.withColumns({"share_ratio": ratio, "price_ratio": price})
    near = F.array_min(F.array(*(F.struct(F.round(F.abs(F.col("share_ratio") / r - 1), 12).alias("d"), F.lit(k).alias("k"), F.lit(r).alias("r")) for k, r in enumerate(CHANGE_RATIOS))))
    a = a.withColumn("near", near)
    is_split = (F.col("near.d") <= 0.02) & (F.abs(F.col("price_ratio") * F.col("near.r") - 1) <= 0.15)
    a = a.withColumn("factor", F.when(F.coalesce(is_split, F.lit(False)), F.col("near.r")).otherwise(1.0)).drop("near")
    flow = F.lit(1.0) if net_flow is None else 1 + net_flow
    a = a.withColumns({"ratio_adj": F.col("share_ratio") / F.col("factor"), "implied_return": F.col("price_ratio") * F.col("factor") - 1})
    grown = F.when((F.col("w0") != 0) & F.col("implied_return").isNotNull(), F.col("w0") * (1 + F.col("implied_return")))
    a = a.withColumn("drift", F.when(F.col("w0") == 0, 0.0).otherwise(F.try_divide(grown, F.sum(grown).over(by))))
    a = a.withColumn("active_weight", F.col("w1") - F.col("drift"))
    kind = (
        F.when(F.col("has0").isNull(), "new").when(F.col("has1").isNull(), "exit")
        .when(F.col("balance0").isNull() | F.col("balance1").isNull(), None)
        .when(F.abs(F.col("ratio_adj") - 1) <= 0.005, "unchanged").when(F.col("ratio_adj") > 1, "increase").otherwise("decrease")
    )
    return a.withColumns({"change": kind, "flow_consistent": F.abs(F.col("ratio_adj") - flow) <= 0.02})


def chained(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Per key the first source's known return, its number, and how far sources disagree at most."""
    tagged = [s.select(*keys, "ret").where(F.col("ret").isNotNull()).withColumn("source_no", F.lit(k)) for k, s in enumerate(sources)]
    every = tagged[0]
    for s in tagged[1:]:
        every = every.unionByName(s)
    return every.groupBy(*keys).agg(F.min_by("ret", "source_no").alias("ret"), F.min("source_no").alias("source_no"), (F.max("ret") - F.min("ret")).alias("disagreement"))
