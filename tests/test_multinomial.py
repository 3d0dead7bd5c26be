"""Shared draws by splitting, and the exact noise floor."""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import functions as F

from rulemark.operators import multinomial


def test_counts_add_up_and_do_not_depend_on_partitions(spark):
    rows = [(g, s, w, 1000 * (g + 1)) for g in range(3) for s, w in enumerate([5.0, 0.0, 1.0, 2.0, None, 8.0, float("nan")][: 5 + g])] + [(7, 0, 0.0, 10), (8, 0, 3.0, 0), (9, 0, 2.0, 12), (None, 0, 1.0, 5), (None, 1, 1.0, 5)]
    df = spark.createDataFrame(rows, "g int, s int, w double, n long")
    one = sorted(map(tuple, multinomial.counts(df.repartition(1), ["g"], "s", "w", "n", 5).select("g", "s", "drawn").na.fill(-1).collect()))
    two = sorted(map(tuple, multinomial.counts(df.repartition(7), ["g"], "s", "w", "n", 5).select("g", "s", "drawn").na.fill(-1).collect()))
    assert one == two
    total = {}
    for g, s, d in one:
        total[g] = total.get(g, 0) + d
    assert total == {0: 1000, 1: 2000, 2: 3000, 7: -1, 8: 0, 9: 12, -1: 5}
    got = {(g, s): d for g, s, d in one}
    assert got[0, 1] == got[0, 4] == got[2, 6] == 0
    assert multinomial.counts(df.limit(0), ["g"], "s", "w", "n", 5).count() == 0


def test_moments_match_the_law(spark):
    p, n, runs = np.array([0.5, 0.3, 0.15, 0.05, 0.0]), 40, 3000
    df = spark.range(runs).select(F.col("id").alias("run"), F.explode(F.array(*(F.struct(F.lit(i).alias("s"), F.lit(float(w)).alias("w")) for i, w in enumerate(p)))).alias("x")).select("run", "x.s", "x.w", F.lit(n).alias("n"))
    got = multinomial.counts(df, ["run"], "s", "w", "n", 1).groupBy("run").agg(F.sort_array(F.collect_list(F.struct("s", "drawn"))).alias("d")).select(F.col("d.drawn").alias("d")).collect()
    x = np.array([r["d"] for r in got])
    assert x.shape == (runs, 5) and (x.sum(1) == n).all()
    assert np.abs(x.mean(0) - n * p).max() < 5 * np.sqrt(n * 0.25 / runs)
    assert np.abs(np.cov(x.T) - n * (np.diag(p) - np.outer(p, p))).max() < 0.9


def test_floor_is_the_mean_over_the_binomial(spark):
    cases = [(1, 0.3), (7, 0.5), (7, 1 / 7), (30, 0.02), (30, 0.98), (12, 0.0), (12, 1.0), (200, 0.37)]
    df = spark.createDataFrame([(k, n, p) for k, (n, p) in enumerate(cases)], "k int, n long, p double")
    got = {r["k"]: r["d"] for r in df.select("k", multinomial.mean_deviation(F.col("n"), F.col("p")).alias("d")).collect()}
    for k, (n, p) in enumerate(cases):
        want = sum(comb(n, x) * p**x * (1 - p) ** (n - x) * abs(x - n * p) for x in range(n + 1))
        assert abs(got[k] - want) < 1e-9, (n, p)
    law = spark.createDataFrame([("a", 0.25, 8)] * 4, "g string, p double, n long")
    assert abs(multinomial.noise_floor(law, ["g"], "p", "n").first()["floor"] - 4 * sum(comb(8, x) * 0.25**x * 0.75 ** (8 - x) * abs(x - 2) for x in range(9)) / 8 / 2) < 1e-9
