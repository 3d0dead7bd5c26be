"""Deterministic random portfolios: draws by hash, policies for weights, rule checks.

Randomness is md5 of (seed, sample, asset), the same in every engine and on every
run, so a draw survives lost executors and repartitioning unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rulemark.operators.cuts import cut

#: Keys that ``first_draws_by`` sorts beyond the first k: so many times the root of k, and so many more.
SPARE = (6, 20)


def key(seed: int, sample: Column, asset: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), sample, asset))


def uniform(digest: Column) -> Column:
    """A number in [0, 1) of a digest: its first 13 hexadecimal digits over 2^52."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def ordered_draws(assets: DataFrame, n_samples: int, seed: int, asset: str = "asset_id") -> DataFrame:
    """Every sample's random order of the assets (sample_id, rank from 1, asset columns).

    The first k of an order are a uniform k-subset, so one order serves every k.
    """
    a = assets.withColumn("sample_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_samples - 1).cast("long"))))
    a = a.withColumn("_key", key(seed, F.col("sample_id"), F.col(asset)))
    w = Window.partitionBy("sample_id").orderBy("_key", asset)
    return a.withColumn("rank", F.row_number().over(w)).drop("_key")


def first_draws(assets: DataFrame, k: DataFrame, n_samples: int, seed: int, asset: str = "asset_id") -> DataFrame:
    """``ordered_draws`` up to rank k, where k is a table of one row and one column k.

    The first k of n keys lie below a threshold a little above k / n, so only keys
    below it are sorted. A sample with fewer than k of them there (all but
    impossible) is drawn again without a threshold: the result is exact.
    """
    sample = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_samples - 1).cast("long")))
    size = assets.agg(F.count("*").alias("_n")).crossJoin(F.broadcast(k.select(F.col("k").alias("_k"))))  # one row each
    share = (F.col("_k") + 6 * F.sqrt(F.col("_k")) + 20) / F.col("_n")
    a = assets.crossJoin(F.broadcast(size)).withColumn("sample_id", sample)  # one row
    a = a.withColumn("_key", key(seed, F.col("sample_id"), F.col(asset)))
    w = Window.partitionBy("sample_id").orderBy("_key", asset)
    low = a.where(uniform(F.col("_key")) < share).withColumns({"rank": F.row_number().over(w), "_low": F.count("*").over(Window.partitionBy("sample_id"))})
    low = low.where(F.col("_low") >= F.least("_k", "_n")).drop("_low")
    full = low.where(F.col("rank") == 1).select("sample_id")
    ids = assets.sparkSession.range(n_samples).select(F.col("id").alias("sample_id"))
    short = ids.join(full, "sample_id", "left_anti")
    rest = assets.crossJoin(F.broadcast(size)).join(F.broadcast(short)).withColumn("_key", key(seed, F.col("sample_id"), F.col(asset)))  # samples by their number: at most n_samples rows, none as a rule
    rest = rest.withColumn("rank", F.row_number().over(w))
    kept = low.unionByName(rest.select(*low.columns))
    return kept.where(F.col("rank") <= F.col("_k")).select(*assets.columns, "sample_id", "rank")


def first_draws_by(assets: DataFrame, k: DataFrame, by: list[str], n_samples: int, seed: int, asset: str = "asset_id") -> DataFrame:
    """First draws of every group of ``by``: (by, sample_id, rank from 1, asset columns) up to the group's k in ``k`` (by, k).

    Keys are md5 of (seed, sample, by, asset). As in ``first_draws`` only keys below a
    bound a little above k / n are sorted, and a group's sample with fewer than k of
    them is drawn again without a bound. Groups are periods or the like: few, of any size.
    """
    size = cut(assets.groupBy(*by).agg(F.count("*").alias("_n")).join(k.select(*by, F.col("k").alias("_k")), by))  # a row a group
    share = (F.col("_k") + SPARE[0] * F.sqrt("_k") + SPARE[1]) / F.col("_n")
    # Keys are compared as text: "g" comes after every hexadecimal digit.
    bound = F.when(share >= 1, "g").otherwise(F.lower(F.lpad(F.hex((share * (1 << 52)).cast("long")), 13, "0")))
    digest = F.md5(F.concat_ws("|", F.lit(seed), "sample_id", *by, asset))
    near = assets.join(F.broadcast(size.withColumn("_bound", bound)), by)  # a row a group
    drawn = near.withColumn("sample_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_samples - 1).cast("long")))).withColumn("_key", digest)
    low = cut(drawn.where(F.col("_key") < F.col("_bound")))
    full = low.groupBy(*by, "sample_id", "_n", "_k").agg(F.count("*").alias("_low")).where(F.col("_low") >= F.least("_k", "_n"))
    every = size.select(*by).crossJoin(assets.sparkSession.range(n_samples).select(F.col("id").alias("sample_id")))
    short = cut(every.join(full, [*by, "sample_id"], "left_anti"))
    if not short.isEmpty():
        rest = near.join(F.broadcast(short), by).withColumn("_key", digest)  # a row a group and sample, none as a rule
        low = low.join(F.broadcast(short), [*by, "sample_id"], "left_anti").unionByName(rest.select(*low.columns))
    order = Window.partitionBy(*by, "sample_id").orderBy("_key", asset)
    ranked = low.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("_k"))
    return ranked.select(*by, "sample_id", "rank", *(c for c in assets.columns if c not in by))


def k_subsets(assets: DataFrame, k: int, n_samples: int, seed: int, asset: str = "asset_id") -> DataFrame:
    """(sample_id, asset columns): n_samples uniform k-subsets."""
    size = assets.sparkSession.range(1).select(F.lit(k).alias("k"))
    return first_draws(assets, size, n_samples, seed, asset).drop("rank")


def combinations(assets: DataFrame, k: int, asset: str = "asset_id", by: Sequence[str] = ()) -> DataFrame:
    """All k-subsets of a small universe, or of each group of ``by``, as arrays in lexicographic order of members."""
    by = list(by)
    out = assets.select(*by, F.array(asset).alias("members"))
    more = assets.select(*(F.col(c).alias(f"_{c}") for c in by), F.col(asset).alias("_n"))
    for _ in range(k - 1):
        same = [F.col(c) == F.col(f"_{c}") for c in by]
        out = out.join(more, [*same, F.element_at("members", -1) < F.col("_n")]).select(*by, F.concat("members", F.array("_n")).alias("members"))
    return out


def keep_first(samples: DataFrame, n: int, accepted: str = "ok", sample: str = "sample_id") -> DataFrame:
    """The first n accepted samples by number, renumbered from 0; the law of accepted draws stays."""
    w = Window.orderBy(sample)  # one row a sample
    return samples.where(accepted).withColumn("kept_no", F.row_number().over(w) - 1).where(F.col("kept_no") < n)


def weights(held: DataFrame, policy: str, by: str = "sample_id", benchmark: str = "bench", variance: str = "variance", score: str = "esg") -> DataFrame:
    """held with the weight ``w`` of each asset in its sample under a policy."""
    w = Window.partitionBy(by)
    raw = {
        "equal": F.lit(1.0), "benchmark": F.col(benchmark).cast("double"),
        "inverse_vol": 1 / F.sqrt(F.greatest(F.col(variance), F.lit(1e-12))), "esg_tilt": F.greatest(F.col(score).cast("double"), F.lit(0.0)),
    }[policy]
    total = F.sum(raw).over(w)
    return held.withColumn("w", F.when(total > 0, raw / total).otherwise(1.0 / F.count("*").over(w)))


def capped(held: DataFrame, cap: float, by: str = "sample_id", weight: str = "w") -> DataFrame:
    """Weights no larger than cap, the excess spread over the rest in proportion.

    In descending order the first j weights are capped, where j is the fewest for
    which the next, rescaled to fill 1 - cap j, fits: the fixpoint of repeated
    capping, from one sort and a running sum. Infeasible caps give null weights.
    """
    order = Window.partitionBy(by).orderBy(F.col(weight).desc(), "asset_id")
    whole = Window.partitionBy(by)
    a = held.withColumns({"_r": F.row_number().over(order), "_before": F.coalesce(F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))})
    # With the r - 1 larger ones capped, would this one fit?
    left = F.sum(weight).over(whole) - F.col("_before")
    fits = F.col(weight) * F.try_divide(1 - cap * (F.col("_r") - 1), left) <= cap + 1e-12
    a = a.withColumn("_j", F.coalesce(F.min(F.when(fits, F.col("_r") - 1)).over(whole), F.count("*").over(whole)))
    rest = F.sum(F.when(F.col("_r") > F.col("_j"), F.col(weight))).over(whole)
    new = F.when(F.col("_r") <= F.col("_j"), F.lit(cap)).otherwise(F.col(weight) * F.try_divide(1 - cap * F.col("_j"), rest))
    feasible = F.count("*").over(whole) * cap >= 1 - 1e-12
    return a.withColumn(weight, F.when(feasible, new)).drop("_r", "_before", "_j")


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of a share p of n."""
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))


def mid_rank(value: Column, x: Column, ties: str = "half") -> Column:
    """Aggregate: percent of values below x; ties count half ("half", or within 1e-12 "half_tol") or not ("strict")."""
    same = {"half": value == x, "half_tol": F.abs(value - x) <= 1e-12, "strict": F.lit(False)}[ties]
    return 100 * F.avg(F.when(same, 0.5).when(value < x, 1.0).otherwise(0.0))


def mid_rank_of(values: Column, x: Column) -> Column:
    """``mid_rank`` of an array of structs with a field ret, ties counted half: one value a row."""
    score = lambda v: F.when(v["ret"] == x, 0.5).when(v["ret"] < x, 1.0).otherwise(0.0)
    return 100 * (F.aggregate(values, F.lit(0.0), lambda a, v: a + score(v)) / F.size(values))


def weighted_quantile(rows: DataFrame, value: str, weight: str, q: float, by: list[str]) -> DataFrame:
    """The least value at which the running weight reaches q of the total (left-continuous inverse)."""
    order = Window.partitionBy(*by).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    a = rows.withColumns({"_c": F.sum(weight).over(order), "_t": F.sum(weight).over(Window.partitionBy(*by))})
    return a.where(F.col("_c") >= q * F.col("_t") - 1e-12).groupBy(*by).agg(F.min(value).alias("quantile"))
