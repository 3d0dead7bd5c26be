"""Queries on swap chains."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemark.operators import chains
from rulemark.plans.lattice import BITS, STATES_SQL, _states
from rulemark.plans.registry import query
from rulemark.sources.tables import read

STEPS = 3
_step = lambda t: f"""d{t} AS (SELECT d.code, d.k, d.p + coalesce(sum(o.p - d.p), 0) / nullif(d.k * ({BITS} - d.k), 0)::DOUBLE AS p FROM d{t - 1} d LEFT JOIN e ON e.a = d.code LEFT JOIN d{t - 1} o ON o.code = e.b GROUP BY d.code, d.k, d.p)"""


@query("swap_chain_tv", f"""WITH {STATES_SQL}, d0 AS (SELECT code, k, CASE WHEN code = min(code) OVER (PARTITION BY k) THEN 1.0::DOUBLE ELSE 0 END AS p FROM f WHERE k < {BITS}), {", ".join(_step(t) for t in range(1, STEPS + 1))}
    SELECT k, count(*) AS n_states, round(sum(abs(p - 1 / n::DOUBLE)) / 2, 8) AS tv FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM d{STEPS}) GROUP BY 1""")
def swap_chain_tv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For states of each size: how far the swap chain from the smallest code still is from uniform."""
    s = _states(spark, sf_dir).where(F.col("k") < BITS)
    first = s.groupBy("k").agg(F.min("code").alias("first"))
    law = s.join(first, "k").select("code", "k", F.when(F.col("code") == F.col("first"), 1.0).otherwise(0.0).alias("p"))
    return chains.distance_to_uniform(chains.walk(law, BITS, STEPS), ["k"]).select("k", "n_states", F.round("tv", 8).alias("tv"))


NEAR, CAP = 0.25, 16
_law = ", ".join(_step(t).replace(f"d{t} AS (", f"d{t} AS MATERIALIZED (", 1) for t in range(1, CAP + 1))
_laws = " UNION ALL ".join(f"SELECT {t} AS t, k, p FROM d{t}" for t in range(CAP + 1))


@query("swap_mixing_time", f"""WITH {STATES_SQL}, d0 AS MATERIALIZED (SELECT code, k, CASE WHEN code = min(code) OVER (PARTITION BY k) THEN 1.0::DOUBLE ELSE 0 END AS p FROM f WHERE k < {BITS}), {_law},
    v AS (SELECT t, k, sum(abs(p - 1 / n::DOUBLE)) / 2 AS tv FROM (SELECT *, count(*) OVER (PARTITION BY t, k) AS n FROM ({_laws})) GROUP BY 1, 2)
    SELECT k, CAST(min(t) FILTER (tv <= {NEAR} + 1e-12) AS INT) AS steps FROM v GROUP BY 1""")
def swap_mixing_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For states of each size: steps from the smallest code until the swap chain is within a quarter of uniform."""
    s = _states(spark, sf_dir).where(F.col("k") < BITS)
    first = s.groupBy("k").agg(F.min("code").alias("first"))
    law = s.join(first, "k").select("code", "k", F.when(F.col("code") == F.col("first"), 1.0).otherwise(0.0).alias("p"))
    return chains.mixing_times(law, BITS, ["k"], NEAR, CAP).select("k", F.col("steps").cast("int").alias("steps"))


@query("swap_spectral_gap", None)
def swap_spectral_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For states of each size: the spectral gap of the swap chain, zero where it is not connected."""
    return chains.spectral_gaps(_states(spark, sf_dir), BITS).select("k", "n_states", F.round("gap", 8).alias("gap"))


@query("swap_chain_samples", None)
def swap_chain_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains over the 25 nations, five held and two of a region at most, one for every supplier, from one nation of each region."""
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = np.array([r[0] for r in nations.orderBy("n_nationkey").select("n_regionkey").collect()])  # 25 rows
    first = nations.groupBy("n_regionkey").agg(F.min("n_nationkey").cast("long").alias("one")).agg(F.array_sort(F.collect_list("one")).alias("members"))
    starts = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("chain_id")).crossJoin(F.broadcast(first))  # one row
    return chains.sampled(starts, len(region), 60, 7, lambda held: np.bincount(region[held]).max() <= 2, burn_in=40, thin=20)


@query("swap_chain_bank", None)
def swap_chain_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain for every customer over the nations, two of a region at most: the share of chains that hold each nation, as the walk goes on."""
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = np.array([r[0] for r in nations.orderBy("n_nationkey").select("n_regionkey").collect()])  # 25 rows
    first = nations.groupBy("n_regionkey").agg(F.min("n_nationkey").cast("long").alias("one")).agg(F.array_sort(F.collect_list("one")).alias("members"))
    starts = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chain_id")).crossJoin(F.broadcast(first))  # one row
    fits = lambda held: (region[held][:, :, None] == np.arange(5)).sum(1).max(1) <= 2
    seen = chains.bank(starts, len(region), 10, 7, fits)
    held = seen.select("step", "accepted", F.explode("members").alias("nation")).groupBy("step", "nation").agg(F.count("*").alias("n"))
    total = seen.groupBy("step").agg(F.count("*").alias("chains"))
    return held.join(total, "step").select("step", "nation", F.round(F.col("n") / F.col("chains"), 6).alias("share"))
