"""Lattices, swaps, exact counts and intervals against brute force."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulemark.functions import estimates
from rulemark.operators import counts, lattice
from rulemark.sources import readers


def test_points_and_unranking(spark):
    grid = lattice.Grid(n=4, units=7, low=2, high=4, k_min=2, k_max=3)
    want = [p for p in itertools.product((0, 2, 3, 4), repeat=4) if sum(p) == 7 and 2 <= sum(q > 0 for q in p) <= 3]
    assert grid.size == len(want)
    assert sorted(tuple(r["point"]) for r in lattice.points(spark, grid).collect()) == want
    rows = spark.createDataFrame([(i,) for i in [*range(-1, len(want) + 1), None]], "i long")
    got = {r["i"]: r["point"] for r in lattice.nth_point(rows, "i", grid).collect()}
    assert [tuple(got[i]) for i in range(len(want))] == want
    assert got[-1] is None and got[len(want)] is None and got[None] is None
    odd = spark.createDataFrame([([1, 2, 4, 0],), ([7, 0, 0, 0],), ([3, 4, 0],), ([3, 4, 0, 0],)], "p array<int>")
    assert [r[0] for r in odd.select(grid.contains(F.col("p"))).collect()] == [False, False, False, True]
    none = lattice.Grid(n=2, units=9, low=1, high=3, k_min=1, k_max=2)
    assert none.size == 0 and lattice.points(spark, none).count() == 0
    with pytest.raises(ValueError):
        lattice.Grid(n=2, units=4, low=3, high=2, k_min=1, k_max=2)


@pytest.mark.parametrize("seed", [1, 2])
def test_swap_components(spark, seed):
    rng = np.random.default_rng(seed)
    codes = sorted(set(rng.integers(0, 256, 60).tolist()) | {0})
    label = {c: c for c in codes}
    near = [(a, b) for a, b in itertools.permutations(codes, 2) if (a ^ b).bit_count() == 2 and a.bit_count() == b.bit_count()]
    for _ in codes:
        for a, b in near:
            label[a] = min(label[a], label[b])
    states = spark.createDataFrame([(c, "x") for c in codes], "code long, tag string")
    got = lattice.swap_components(states, 8).collect()
    assert {r["code"]: r["component"] for r in got} == label and {r["tag"] for r in got} == {"x"}
    degrees = {r["code"]: r["degree"] for r in lattice.swap_degrees(states, 8).collect()}
    assert degrees == {c: sum(a == c for a, _ in near) for c in codes}
    assert lattice.swap_components(states.limit(0), 8).count() == 0


def test_subset_counts(spark):
    rows = [(f"s{i % 3}", i * 7 % 5) for i in range(11)]
    want: dict = {}
    for chosen in itertools.combinations(rows, 4):
        sectors = [s for s, _ in chosen]
        if max(map(sectors.count, sectors)) <= 2:
            total = sum(v for _, v in chosen)
            want[total] = want.get(total, 0) + 1
    df = spark.createDataFrame([*rows, ("s0", None)], "sector string, score long")
    found = counts.score_counts(df, 4, F.col("score"), F.col("sector"), 2).collect()
    assert {r["total"]: int(r["ways"]) for r in found} == want
    assert counts.score_counts(df, 7, F.col("score"), F.col("sector"), 2).count() == 0


def test_clopper_pearson(spark):
    cases = [(0, 5), (5, 5), (2, 9), (1, 400), (37, 120), (0, 1)]
    df = spark.createDataFrame([*cases, (1, 0), (3, 2), (None, 4)], "h long, n long")
    got = [r[0] for r in df.select(estimates.clopper_pearson(F.col("h"), F.col("n"), 0.9)).collect()]
    tail = lambda n, p, hs: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in hs)
    for (h, n), r in zip(cases, got, strict=False):
        assert r["low"] == 0 if h == 0 else tail(n, r["low"], range(h, n + 1)) == pytest.approx(0.05, abs=1e-6)
        assert r["high"] == 1 if h == n else tail(n, r["high"], range(h + 1)) == pytest.approx(0.05, abs=1e-6)
    assert all(r["low"] is None and r["high"] is None for r in got[len(cases) :])
    large = spark.createDataFrame([(400_000, 1_000_000)], "h long, n long").select(estimates.clopper_pearson(F.col("h"), F.col("n"))).first()[0]
    assert large["low"] == pytest.approx(0.4 - 1.96 * math.sqrt(0.24 / 1e6), abs=2e-6)


def test_isotonic(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 40):
        y, w = rng.normal(size=n).round(1), rng.integers(1, 4, n).astype(float)
        mean = lambda i, j: (y[i : j + 1] * w[i : j + 1]).sum() / w[i : j + 1].sum()  # noqa: B023, E731
        want = [max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
        assert estimates.pooled_levels(y, w) == pytest.approx(want)
    rows = [("a", 2, 1.0, 1), ("a", 1, 3.0, 1), ("a", 1, 1.0, 1), ("a", 3, 5.0, 1), ("a", None, 9.0, 1), ("a", 3, -9.0, 0), ("b", 1, 4.0, 2)]
    fit = estimates.isotonic(spark.createDataFrame(rows, "g string, x int, y double, w int"), ["g"], "x", "y", "w")
    assert sorted(map(tuple, fit.collect())) == [("a", 1, pytest.approx(5 / 3)), ("a", 2, pytest.approx(5 / 3)), ("a", 3, 5.0), ("b", 1, 4.0)]


def test_period_returns(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("security_key,start,end,total_return\nA,2020-01-01,2020-03-31,0.5\nB,2020-01-01,2020-03-31,\nA,2020-04-01,2020-06-30,0.1\nA,2020-04-01,2020-06-30,0.2\n")
    assert [tuple(r) for r in readers.period_returns(spark, str(path), "2020-01-01", "2020-03-31").collect()] == [("A", 0.5)]
    with pytest.raises(ValueError, match="several"):
        readers.period_returns(spark, str(path), "2020-04-01", "2020-06-30")
    path.write_text("security_key,start\nA,1\n")
    with pytest.raises(ValueError, match="lacks"):
        readers.period_returns(spark, str(path), "1", "2")
