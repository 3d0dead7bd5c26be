"""Queries on counts of many draws and on what chance alone explains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemark.operators import multinomial
from rulemark.plans.registry import query
from rulemark.sources.tables import read

R = F.round


def _law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, nation, weight, p, draws): the shares of a region's customers by nation; as many draws as the region has customers."""
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"))
    n = read(spark, sf_dir, "customer").join(nation, "c_nationkey").groupBy("region", F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("weight"))
    total = n.groupBy("region").agg(F.sum("weight").alias("draws"))
    return n.join(total, "region").withColumn("p", F.col("weight") / F.col("draws"))


@query("tv_noise_floor", """WITH n AS (SELECT n_regionkey AS region, count(*) AS w FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey, n_nationkey), l AS (SELECT region, sum(w) OVER (PARTITION BY region)::DOUBLE AS n, w / sum(w) OVER (PARTITION BY region)::DOUBLE AS p FROM n),
    m AS (SELECT *, floor(n * p) + 1 AS m FROM l), d AS (SELECT region, n, CASE WHEN p < 1 AND m <= n THEN 2 * m * exp(lgamma(n + 1) - lgamma(m + 1) - lgamma(n - m + 1) + m * ln(p) + (n - m + 1) * ln(1 - p)) ELSE 0 END AS d FROM m)
    SELECT region, count(*) AS n_states, round(sum(d / n) / 2, 8) AS floor FROM d GROUP BY 1""")
def tv_noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a sample as large as a region's customers strays from their shares by nation, on average."""
    return multinomial.noise_floor(_law(spark, sf_dir), ["region"], "p", "draws").select("region", "n_states", R("floor", 8).alias("floor"))


@query("tv_of_shared_draws", None)
def tv_of_shared_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample of each region's size drawn at once, and its distance from the law beside the floor."""
    law = _law(spark, sf_dir)
    drawn = multinomial.counts(law, ["region"], "nation", "weight", "draws", 11)
    tv = drawn.groupBy("region").agg(F.sum("drawn").alias("drawn"), (F.sum(F.abs(F.col("drawn") / F.col("draws") - F.col("p"))) / 2).alias("tv"))
    return tv.join(multinomial.noise_floor(law, ["region"], "p", "draws"), "region").select("region", "n_states", "drawn", R("tv", 8).alias("tv"), R("floor", 8).alias("floor"))
