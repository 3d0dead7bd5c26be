"""Counts of many draws from a law over many states, and how far such counts stray from it by chance alone.

Counts are drawn without drawing: the number of draws is split in two between
the halves of the states by a binomial number, each half again, down to single
states. That is one multinomial draw, whatever the number of draws, in as many
rounds as states have binary digits. Every split takes its random numbers from
the seed and its own place in the tree, so a repeated task splits the same way
and nothing depends on partitions; groups that share a seed share no place.

Defined results: null, negative and non-finite weights count as zero; a group
whose weights add up to zero gets null counts; no draws give zeros.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rulemark.operators.cuts import cut


def _weight(c: str) -> Column:
    return F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.col(c) < 0) | (F.col(c) == float("inf")), 0.0).otherwise(F.col(c).cast("double"))


def counts(law: DataFrame, by: Sequence[str], state: str, weight: str, draws: str, seed: int, out: str = "drawn") -> DataFrame:
    """law (by, state, weight, draws: one number a group) with ``out``: how many of a group's draws fell on the state."""
    by = list(by)
    place = Window.partitionBy(*by).orderBy(state) if by else Window.orderBy(state)  # a row a state
    rows = cut(law.withColumns({"_w": _weight(weight), "_i": F.row_number().over(place).cast("long") - 1}))
    most = rows.agg(F.max("_i")).first()[0]  # one number
    if most is None:
        return rows.drop("_w", "_i").withColumn(out, F.lit(None).cast("long"))
    depth = max(1, int(most).bit_length())
    group = F.xxhash64(F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by))
    head = rows.groupBy(*by).agg(F.first(draws).cast("long").alias("_n"), F.sum("_w").alias("_total"))
    nodes = head.where("_total > 0 AND _n IS NOT NULL").select(*by, F.lit(0).cast("long").alias("_node"), "_n", group.alias("_g"))
    right = lambda x: F.call_function("shiftright", "_i", F.lit(x))

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            left, n, share = frame["_left"].to_numpy(float), frame["_n"].to_numpy(), frame["_both"].to_numpy(float)
            p = np.clip(np.divide(left, share, out=np.zeros(len(frame)), where=share > 0), 0, 1)
            taken = [int(np.random.default_rng([g & 0xFFFFFFFFFFFFFFFF, level, node]).binomial(m, q)) if m else 0 for g, level, node, m, q in zip(frame["_g"].tolist(), frame["_level"].tolist(), frame["_node"].tolist(), n.tolist(), p.tolist(), strict=True)]
            yield frame.assign(_taken=taken)[[c for c in frame.columns if c not in ("_left", "_both", "_level")] + ["_taken"]]

    for level in range(depth):
        below = rows.groupBy(*by, right(depth - level - 1).alias("_child")).agg(F.sum("_w").alias("_w"))
        pair = below.groupBy(*by, F.call_function("shiftright", "_child", F.lit(1)).alias("_node")).agg(F.coalesce(F.sum(F.when(F.col("_child") % 2 == 0, F.col("_w"))), F.lit(0.0)).alias("_left"), F.sum("_w").alias("_both"))
        open_ = nodes.alias("x").join(pair.alias("y"), [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in [*by, "_node"]])
        open_ = open_.select(*(F.col(f"x.{c}").alias(c) for c in [*by, "_node", "_n", "_g"]), "_left", "_both", F.lit(level).alias("_level"))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in open_.schema if f.name not in ("_left", "_both", "_level"))
        halves = cut(open_.mapInPandas(split, f"{kinds}, _taken long"))
        side = F.explode(F.array(F.struct((F.col("_node") * 2).alias("c"), F.col("_taken").alias("m")), F.struct((F.col("_node") * 2 + 1).alias("c"), (F.col("_n") - F.col("_taken")).alias("m"))))
        nodes = halves.select(*by, "_g", side.alias("s")).select(*by, F.col("s.c").alias("_node"), F.col("s.m").alias("_n"), "_g").where("_n > 0")
    found = nodes.select(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), F.col("_node").alias("_at"), F.col("_n").alias("_got"))
    on = [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)] + [F.col("_i") == F.col("_at")]
    joined = rows.join(found, on, "left").select(*rows.columns, "_got")
    known = head.where("_total > 0 AND _n IS NOT NULL").select(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), F.lit(0).cast("long").alias("_zero"))
    known = joined.join(known, [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)] or F.lit(True), "left")
    return known.select(*law.columns, F.coalesce("_got", "_zero").alias(out))


def _log_gamma(x: pd.Series) -> pd.Series:
    """Stirling's series, from 12 on after the recurrence: right to some 1e-13 of the value."""
    x, shift = x.to_numpy(float), np.zeros(len(x))
    for _ in range(12):
        small = x < 12
        shift = shift - np.where(small, np.log(np.where(small, x, 1.0)), 0.0)
        x = np.where(small, x + 1, x)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * x * x)) / (x * x)) / (x * x)) / x
    return pd.Series((x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series + shift)


def mean_deviation(n: Column, p: Column) -> Column:
    """E|X - np| of a binomial X, in closed form (de Moivre's): 2 m C(n, m) p^m (1 - p)^(n - m + 1) at m = floor(np) + 1."""
    log_gamma = F.pandas_udf(_log_gamma, "double")
    n = n.cast("double")
    m = F.floor(n * p).cast("double") + 1
    inside = F.when((p > 0) & (p < 1) & (m <= n), True)
    safe_m, safe_p = F.coalesce(F.when(inside, m), F.lit(1.0)), F.coalesce(F.when(inside, p), F.lit(0.5))
    ways = log_gamma(n + 1) - log_gamma(safe_m + 1) - log_gamma(F.greatest(n - safe_m, F.lit(0.0)) + 1)
    return F.when(inside, 2 * safe_m * F.exp(ways + safe_m * F.ln(safe_p) + (n - safe_m + 1) * F.ln(1 - safe_p))).otherwise(0.0)


def noise_floor(law: DataFrame, by: Sequence[str], p: str, draws: str) -> DataFrame:
    """(by, n_states, floor): the total variation from a law that ``draws`` independent draws from it show on average, exactly."""
    off = mean_deviation(F.col(draws), F.col(p)) / F.col(draws).cast("double")
    rows = law.withColumn("_off", off)
    return rows.groupBy(*by).agg(F.count("*").alias("n_states"), (F.sum("_off") / 2).alias("floor"))
