"""Global ranks and running sums by ranges."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from rulemark.operators import ordering


def test_ranks_and_running_sums(spark):
    rng = random.Random(1)
    rows = [(k, rng.randint(0, 40) if k % 9 else None, float(rng.randint(0, 5)), None if k % 7 == 0 else 1.0) for k in range(500)]
    df = spark.createDataFrame(rows, "id int, x int, a double, b double").repartition(5)
    got = {r["id"]: (r["rank"], r["rank_total"]) for r in ordering.ranked(df, ["x", "id"]).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert got == {r[0]: (k, 500) for k, r in enumerate(order)}
    one = df.where("x IS NOT NULL").groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    runs = sorted((r["x"], r["a_run"], r["b_run"], r["a_all"], r["next"]) for r in ordering.running(one, "x", ["a", "b"]).collect())
    plain = sorted((r["x"], r["a"], r["b"] or 0.0) for r in one.collect())
    a = b = 0.0
    for k, (x, da, db) in enumerate(plain):
        a, b = a + da, b + db
        assert runs[k] == (x, a, b, sum(p[1] for p in plain), plain[k + 1][0] if k + 1 < len(plain) else None)
    assert ordering.ranked(df.limit(0), ["x"]).count() == 0 == ordering.running(one.limit(0), "x", ["a"]).count()


def test_quantiles_of_few_large_groups(spark):
    """Exact quantiles as percentile gives them, with ties, one value, nulls, and no aggregation that gathers a group."""
    from pyspark.sql import functions as F

    from rulemark.operators import ordering

    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 7 == 0, "b").when(F.col("id") == 1, "c").otherwise("d").alias("g"), F.when(F.col("id") % 11 != 0, F.pmod(F.xxhash64("id"), F.lit(900)) / 7.0).alias("v"))
    got = ordering.quantiles(rows, "g", "v", {"m": 0.5, "t": 0.95})
    want = rows.groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", F.lit(0.5)).alias("m"), F.percentile("v", F.lit(0.95)).alias("t"))
    key = lambda df: sorted((r["g"], r["n"], round(r["m"], 9), round(r["t"], 9)) for r in df.collect())
    assert key(got) == key(want)
    assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString()
