"""Exact counts by polynomials against enumeration."""

from __future__ import annotations

import itertools
import random
from math import comb, prod

import pytest
from pyspark.sql import functions as F

from rulemark.operators import counts
from rulemark.operators.counts import Axis, Mean


def universe(n=11, seed=3):
    rng = random.Random(seed)
    return [(a, rng.choice("ABC"), rng.randint(0, 4), rng.randint(0, 1), rng.uniform(0, 10), rng.uniform(0, 10)) for a in range(n)]


FIELDS = "asset_id long, sector string, w int, m int, x double, y double"


def sets(rows, k, cap):
    for c in itertools.combinations(rows, k):
        if all(sum(r[1] == s for r in c) <= cap for s in "ABC"):
            yield c


def test_remainders_go_together():
    ps = counts.primes(200)
    assert prod(ps).bit_length() > 200 and len(set(ps)) == len(ps) and all(p < 1 << 31 for p in ps)
    for x in (0, 1, 12345678901234567890, comb(600, 60) % (1 << 200)):
        assert counts.together([x % p for p in ps], ps) == x


@pytest.mark.parametrize(("k", "cap"), [(4, 2), (1, 11), (0, 2), (9, 2)])
def test_counts_match_enumeration(spark, k, cap):
    rows = universe()
    df = spark.createDataFrame([*rows, (90, None, 1, 1, 1.0, 1.0), (91, "A", None, 1, 1.0, 1.0)], FIELDS)
    axes = [Axis(F.col("w"), 5), Axis(F.col("m"), 1, 2)]
    want = sum(sum(r[2] for r in c) >= 5 and 1 <= sum(r[3] for r in c) <= 2 for c in sets(rows, k, cap))
    assert int(counts.subset_count(df, k, axes, F.col("sector"), cap).first()[0]) == want


def test_numbers_beyond_any_long(spark):
    df = spark.range(3000).select(F.col("id").alias("asset_id"), F.lit("A").alias("sector"), (F.col("id") % 2).alias("w"))
    assert int(counts.subset_count(df, 25, [], F.col("sector")).first()[0]) == comb(3000, 25)
    got = {r["total"]: int(r["ways"]) for r in counts.score_counts(df, 20, F.col("w"), F.col("sector")).collect()}
    assert got == {j: comb(1500, j) * comb(1500, 20 - j) for j in range(21)}


def test_empty_universe(spark):
    none = spark.createDataFrame([], FIELDS)
    assert [counts.subset_count(none, k, [], F.col("sector")).first()[0] for k in (0, 1)] == ["1", "0"]
    assert counts.subset_count(none, 0, [Axis(F.col("w"), 1)], F.col("sector")).first()[0] == "0"


@pytest.mark.parametrize("bins", [4, 12])
def test_share_lies_between_its_bounds(spark, bins):
    rows = universe(12, 8)
    df = spark.createDataFrame(rows, FIELDS)
    rule, fund = Mean("x", 4.0), Mean("y", 5.5, at_least=False, strict=True)
    r = counts.share_below(df, 4, [rule], fund, bins, F.col("sector"), 2).first()
    ruled = [c for c in sets(rows, 4, 2) if sum(a[4] for a in c) / 4 >= 4.0]
    true = sum(sum(a[5] for a in c) / 4 < 5.5 for c in ruled) / len(ruled)
    assert r["low"] <= true <= r["high"] and r["low"] <= r["share"] <= r["high"]
    scale, lo = (bins - 1) / (max(a[4] for a in rows) - min(a[4] for a in rows)), min(a[4] for a in rows)
    w = {a[0]: round(scale * (a[4] - lo)) for a in rows}
    assert int(r["ruled"]) == sum(sum(w[a[0]] for a in c) >= counts.thresholds(scale * 4 * (4.0 - lo), 4, False)[1] for c in sets(rows, 4, 2))
