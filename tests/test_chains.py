"""Swap chains against brute force."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from rulemark.operators import chains

CODES = [sum(1 << b for b in c) for c in itertools.combinations(range(6), 3)]


def brute(states: list[int], bits: int, law: np.ndarray, steps: int) -> np.ndarray:
    k = bin(states[0]).count("1")
    q = np.array([[1 / (k * (bits - k)) if bin(a ^ b).count("1") == 2 else 0.0 for b in states] for a in states])
    q += np.diag(1 - q.sum(1))
    return law @ np.linalg.matrix_power(q, steps)


@pytest.mark.parametrize("states", [CODES, CODES[::2], CODES[:4] + CODES[-1:], CODES[:1]])
def test_law_after_steps(spark, states):
    law = np.zeros(len(states))
    law[0] = 1
    df = spark.createDataFrame(list(zip(states, law.tolist(), strict=True)), "code long, p double")
    for steps in (0, 1, 4):
        got = {r.code: r.p for r in chains.walk(df, 6, steps).collect()}
        want = brute(states, 6, law, steps)
        assert np.allclose([got[s] for s in states], want, atol=1e-12)
        tv = chains.distance_to_uniform(chains.walk(df, 6, steps).selectExpr("1 AS g", "p"), ["g"]).first().tv
        assert abs(tv - np.abs(want - 1 / len(states)).sum() / 2) < 1e-12


def test_sizes_without_swaps_stay(spark):
    df = spark.createDataFrame([(0, 1.0), (7, 1.0)], "code long, p double")
    assert sorted(map(tuple, chains.walk(df, 3, 2).collect())) == [(0, 1.0), (7, 1.0)]


def test_sampled_chains(spark):
    starts = spark.createDataFrame([(i, [0, 1]) for i in range(60)], "chain_id long, members array<long>")
    allowed = lambda held: not (4 in held and 5 in held)
    run = lambda parts, **more: {(r.chain_id, r.step): tuple(r.members) for r in chains.sampled(starts.repartition(parts), 6, 200, 3, allowed, burn_in=50, thin=10, **more).collect()}
    got = run(1)
    assert len(got) == 60 * 20 and got == run(5)
    assert all(len(m) == 2 and allowed(m) for m in got.values())
    counts = np.unique(list(got.values()), axis=0, return_counts=True)[1]
    assert len(counts) == 14 and abs(counts / 1200 - 1 / 14).max() < 0.03
    assert len(set(run(2, swaps=2).values())) == 14
    with pytest.raises(Exception, match="outside the feasible set"):
        chains.sampled(spark.createDataFrame([(1, [4, 5])], "chain_id long, members array<long>"), 6, 5, 3, allowed).collect()


@pytest.mark.parametrize("states", [CODES, CODES[::2] + CODES[1::4], CODES[:4] + CODES[-1:], CODES[:1], CODES[:2]])
def test_gap_and_mixing_time_match_numpy(spark, states):
    found = chains.spectral_gaps(spark.createDataFrame([(s,) for s in states], "code long"), 6).first()
    k = 3
    q = np.array([[1 / (k * 3) if bin(a ^ b).count("1") == 2 else 0.0 for b in states] for a in states])
    q += np.diag(1 - q.sum(1))
    values = np.delete(np.linalg.eigvalsh(q), -1)
    want = 1 - np.abs(values).max() if len(states) > 1 else 1.0
    assert (found["k"], found["n_states"]) == (3, len(states)) and abs(found["gap"] - max(want, 0)) < 1e-8
    starts = [(a, b, float(a == b)) for a in states for b in states]
    times = chains.mixing_times(spark.createDataFrame(starts, "start long, code long, p double"), 6, ["start"], 0.25, 12)
    for r in times.collect():
        law, at, t = np.eye(len(states))[states.index(r["start"])], None, 0
        while at is None and t <= 12:
            at = t if np.abs(law - 1 / len(states)).sum() / 2 <= 0.25 + 1e-12 else None
            law, t = law @ q, t + 1
        assert r["steps"] == at


def test_gaps_of_all_sizes_at_once(spark):
    rng = np.random.default_rng(1)
    codes = sorted({int(c) for c in rng.integers(0, 1 << 8, 170)})
    got = {r["k"]: r["gap"] for r in chains.spectral_gaps(spark.createDataFrame([(c,) for c in codes], "code long"), 8).collect()}
    for k in got:
        mine = [c for c in codes if bin(c).count("1") == k]
        if 0 < k < 8 and len(mine) > 1:
            q = np.array([[1 / (k * (8 - k)) if bin(a ^ b).count("1") == 2 else 0.0 for b in mine] for a in mine])
            q += np.diag(1 - q.sum(1))
            assert abs(got[k] - max(1 - np.abs(np.linalg.eigvalsh(q)[:-1]).max(), 0)) < 1e-8, k
    assert chains.spectral_gaps(spark.createDataFrame([], "code long"), 8).count() == 0


def test_bank_follows_the_law(spark):
    states = CODES[::2] + CODES[1::4]
    known = np.array(states)
    fits = lambda held: np.isin((1 << held).sum(1), known)
    first = [b for b in range(6) if states[0] >> b & 1]
    n = 20000
    starts = spark.range(n).selectExpr("id AS chain_id", f"array({', '.join(map(str, first))}) AS members")
    got = chains.bank(starts.repartition(3), 6, 5, 1, fits)
    assert chains.checkpoints(6) == [1, 2, 3, 4, 6, 8]
    counts = {(r["step"], sum(1 << b for b in r["members"])): r["count"] for r in got.groupBy("step", "members").count().collect()}
    for t in chains.checkpoints(5):
        law = brute(states, 6, np.eye(len(states))[0], t)
        seen = np.array([counts.get((t, s), 0) for s in states]) / n
        assert sum(counts.get((t, s), 0) for s in states) == n
        assert np.abs(seen - law).max() < 5 * np.sqrt(0.25 / n)
    again = chains.bank(starts.repartition(1), 6, 5, 1, fits)
    assert got.exceptAll(again).count() == 0


def test_bank_edges(spark):
    df = spark.createDataFrame([(1, []), (2, [0, 1, 2]), (3, [1])], "chain_id long, members array<long>")
    got = {(r["chain_id"], r["step"]): r for r in chains.bank(df, 3, 2, 1, lambda held: np.ones(len(held), bool)).collect()}
    assert got[1, 2]["members"] == [] and got[2, 2]["members"] == [0, 1, 2] and len(got[3, 1]["members"]) == 1
    assert chains.bank(df.limit(0), 3, 2, 1, lambda held: np.ones(len(held), bool)).count() == 0
    with pytest.raises(Exception, match="outside"):
        chains.bank(df, 3, 2, 1, lambda held: np.zeros(len(held), bool)).collect()


def test_chains_of_one_file_are_spread(spark):
    starts = spark.createDataFrame([(i, [0, 1]) for i in range(50)], "chain_id long, members array<long>").coalesce(1)
    seen = chains.sampled(starts, 6, 10, 3, lambda held: True)
    assert seen.rdd.getNumPartitions() > 1 and seen.count() == 500
