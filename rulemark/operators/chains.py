"""Metropolis chains of single swaps between feasible portfolios: exact laws and sampled walks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulemark.operators.cuts import cut, spread
from rulemark.operators.lattice import _without_one

Accept = Callable[[np.ndarray], bool]


def step(law: DataFrame, bits: int, code: str = "code", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """The law of a swap chain one step on; law holds every feasible state (distinct codes, for each value of ``by``) with its probability.

    A proposal swaps one of k members for one of bits - k others, each as likely; one
    that is not feasible stays. What flows in is each shared remainder's total less
    the state's own part, so neighbours are never listed in pairs. Sizes of nothing or
    of everything have no swap and keep their law. ``p`` may be any function on the
    states: the kernel is symmetric.
    """
    k, by = F.bit_count(code), list(by)
    by_rest = _without_one(law.select(*by, code, p), code, bits)
    total = by_rest.groupBy(*by, "_rest").agg(F.sum(p).alias("_total"), (F.count("*") - 1).alias("_others"))
    flow = by_rest.join(total, [*by, "_rest"]).groupBy(*by, code).agg(F.sum(F.col("_total") - F.col(p) - F.col("_others") * F.col(p)).alias("_net"))
    return law.join(flow, [*by, code], "left").withColumn(p, F.col(p) + F.coalesce(F.try_divide("_net", k * (bits - k)), F.lit(0.0))).drop("_net")


def walk(law: DataFrame, bits: int, steps: int, code: str = "code", p: str = "p") -> DataFrame:
    """The law after a number of steps, its lineage cut after each."""
    for _ in range(steps):
        law = cut(step(law, bits, code, p))
    return law


def distance_to_uniform(law: DataFrame, by: list[str], p: str = "p") -> DataFrame:
    """(by, n_states, tv): total variation between a group's law and the uniform one on its states."""
    size = law.groupBy(*by).agg(F.count("*").alias("n_states"))
    return law.join(size, by).groupBy(*by, "n_states").agg((F.sum(F.abs(F.col(p) - 1 / F.col("n_states"))) / 2).alias("tv"))


def mixing_times(law: DataFrame, bits: int, by: Sequence[str], eps: float = 0.25, max_steps: int = 1000, code: str = "code", p: str = "p") -> DataFrame:
    """(by, steps): the first number of steps after which each group's law is within eps of uniform on its states, in total variation; null if more than max_steps.

    law: a starting law for every group. Groups that have got there take no further
    part. For the worst start, let ``by`` hold the start: one group a start.
    """
    by = list(by)
    law = cut(law.select(*by, code, p))
    groups, found, t = law.select(*by).distinct(), None, 0
    while True:
        near = cut(distance_to_uniform(law, by, p).where(F.col("tv") <= eps + 1e-12).select(*by, F.lit(t).alias("steps")))
        found = near if found is None else cut(found.unionByName(near))
        law = law.join(near.select(*by), by, "left_anti")
        if t == max_steps or not law.limit(1).count():
            return groups.join(found, by, "left")
        law, t = cut(step(law, bits, code, p, by)), t + 1


def _ends(alpha: list[float], beta: list[float]) -> tuple[tuple[float, float], float]:
    """The least and greatest eigenvalue of the recurrence's matrix, and how far they may still be from the kernel's (their residuals)."""
    between = beta[: len(alpha) - 1]
    values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(between, 1) + np.diag(between, -1))
    return (values[0], values[-1]), beta[-1] * max(abs(vectors[-1, 0]), abs(vectors[-1, -1]))


def spectral_gaps(states: DataFrame, bits: int, tol: float = 1e-6, max_steps: int = 200, code: str = "code") -> DataFrame:
    """(k, n_states, gap, steps): for states of each size k, 1 less the greatest modulus of the swap kernel's eigenvalues besides that of the uniform law.

    0 where swaps leave islands or the chain alternates, 1 for a single state. The
    eigenvalues come from Lanczos' recurrence on functions that sum to zero: all
    sizes walk together, a vector is a column over the states, one step one pass of
    shared remainders and one aggregation. Only three numbers a size and step reach
    the driver, bits + 1 sizes at most. A size leaves when the residuals of its
    extreme values are below ``tol`` (the values are then off by about its square).
    """
    noise = F.xxhash64(code) % 1_000_003 / F.lit(1e6)
    sized = states.select(code, F.bit_count(code).alias("k")).distinct()
    stats = {r["k"]: r for r in sized.groupBy("k").agg(F.count("*").alias("n"), F.avg(noise).alias("mean"), F.sum(noise * noise).alias("square")).collect()}
    ends = dict.fromkeys(stats, (0.0, 0.0))
    took = dict.fromkeys(stats, 0)
    alpha: dict[int, list[float]] = {k: [] for k in stats}
    beta: dict[int, list[float]] = {k: [] for k in stats}

    def of(values: dict[int, float]) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for k, v in values.items() for x in (k, float(v)))), F.col("k"))

    norm = {k: (r["square"] - r["n"] * r["mean"] ** 2) ** 0.5 for k, r in stats.items() if r["n"] > 1}
    live = sorted(norm)
    if live:
        law = cut(sized.where(F.col("k").isin(live)).select(code, "k", F.lit(0.0).alias("before"), ((noise - of({k: stats[k]["mean"] for k in live})) / of(norm)).alias("v")))
    for t in range(max_steps):
        if not live:
            break
        # r = P v - beta * (vector before); the kernel is symmetric, so this is what three terms need.
        image = step(law.where(F.col("k").isin(live)).withColumn("w", F.col("v")), bits, code, "w")
        image = cut(image.select(code, "k", "v", (F.col("w") - (of({k: beta[k][-1] for k in live}) if t else F.lit(0.0)) * F.col("before")).alias("r")))
        sums = {r["k"]: r for r in image.groupBy("k").agg(F.sum(F.col("r") * F.col("v")).alias("rv"), F.avg("r").alias("mean"), F.avg("v").alias("vm")).collect()}
        shift = {k: sums[k]["mean"] - sums[k]["rv"] * sums[k]["vm"] for k in live}
        new = F.col("r") - of({k: sums[k]["rv"] for k in live}) * F.col("v") - of(shift)
        # The length of what is left, from the vector itself: a difference of squares would be mostly noise near the end.
        rest = {r["k"]: r["length"] for r in image.groupBy("k").agg(F.sqrt(F.sum(new * new)).alias("length")).collect()}
        for k in live:
            alpha[k].append(sums[k]["rv"])
            beta[k].append(rest[k])
            ends[k], error = _ends(alpha[k], beta[k])
            took[k] = t + 1
            if error < tol or rest[k] < 1e-12:
                rest[k] = 0.0
        live = [k for k in live if rest[k]]
        if live:
            here = image.where(F.col("k").isin(live))
            law = here.select(code, "k", F.col("v").alias("before"), (new / of({k: rest[k] for k in live})).alias("v"))
    if live:
        raise RuntimeError(f"the spectrum did not settle in {max_steps} steps for sizes {live}")
    gap = {k: 1.0 if r["n"] < 2 else max(0.0, 1 - max(abs(x) for x in ends[k])) for k, r in stats.items()}
    rows = [(k, stats[k]["n"], 0.0 if gap[k] < 1e-9 else float(gap[k]), took[k]) for k in sorted(stats)]
    return states.sparkSession.createDataFrame(rows, "k int, n_states long, gap double, steps int")


def sampled(starts: DataFrame, n: int, steps: int, seed: int, accept: Accept, burn_in: int = 0, thin: int = 1, swaps: int = 1) -> DataFrame:
    """(chain_id, step, members, accepted): every ``thin``-th state after ``burn_in`` of each chain, and its share of accepted moves so far.

    starts: (chain_id, members), distinct asset numbers below n. A proposal makes
    ``swaps`` swaps and is taken where ``accept`` (of the sorted members) allows it.
    A chain's random numbers depend on seed and chain_id only, so a repeated task
    walks the same way. A start that is not accepted raises; an empty or full
    portfolio stays as it is.
    """

    def walk_all(ids: np.ndarray, held: np.ndarray) -> Iterator[pd.DataFrame]:
        """Chains of one size in step; members and free assets stay sorted, as the drawn places count along them."""
        rows, k = np.arange(len(ids)), held.shape[1]
        inside = np.zeros((len(ids), n), bool)
        inside[rows[:, None], held] = True
        held = np.sort(held, axis=1)
        for i in rows:
            if inside[i].sum() != k or not accept(held[i]):
                raise ValueError(f"chain {ids[i]} starts outside the feasible set")
        free = np.nonzero(~inside)[1].reshape(len(ids), n - k)
        moves = swaps if 0 < k < n else 0
        bounds = np.tile([k, n - k], (burn_in + steps) * moves)
        drawn = np.stack([np.random.default_rng([seed, int(i)]).integers(0, bounds) for i in ids]) if moves else None
        taken = np.zeros(len(ids), np.int64)
        for t in range(1, burn_in + steps + 1):
            new, rest = held.copy(), free.copy()
            for m in range(moves):
                at = 2 * ((t - 1) * moves + m)
                out, into = drawn[:, at], drawn[:, at + 1]
                new[rows, out], rest[rows, into] = rest[rows, into], new[rows, out]
                new.sort(axis=1)
                rest.sort(axis=1)
            moved = np.flatnonzero((new != held).any(axis=1))
            ok = moved[np.array([bool(accept(new[i])) for i in moved], bool)] if len(moved) else moved
            held[ok], free[ok] = new[ok], rest[ok]
            taken[ok] += 1
            if t > burn_in and (t - burn_in) % thin == 0:
                yield pd.DataFrame({"chain_id": ids, "step": t, "members": list(held.copy()), "accepted": taken / t})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                some = batch.iloc[at : at + 1024]
                for _, same in some.groupby(some["members"].map(len)):
                    yield from walk_all(same["chain_id"].to_numpy(np.int64), np.stack([np.asarray(m, np.int64) for m in same["members"]]).reshape(len(same), -1))

    # A chain takes much longer to walk than to read, so chains are spread however few files hold them.
    return spread(starts.select("chain_id", "members"), "chain_id").mapInPandas(work, "chain_id long, step long, members array<long>, accepted double")


def _uniform(seed: int, chain: np.ndarray, step: int, which: int) -> np.ndarray:
    """A number in [0, 1) for each chain, from seed, chain, step and purpose alone (the splitmix finaliser, twice)."""
    x = chain.astype(np.int64).view(np.uint64)
    for salt in (seed * 0x9E3779B97F4A7C15, (2 * step + which + 1) * 0xD1B54A32D192ED03):
        x = x + np.uint64(salt & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)) / float(1 << 53)


def checkpoints(halves: int) -> list[int]:
    """The steps 1, 2, 3, 4, 6, 8, 12, ...: 2 to the power of j / 2, rounded up, for j up to ``halves``."""
    return sorted({int(np.ceil(2 ** (j / 2) - 1e-9)) for j in range(halves + 1)})


def bank(starts: DataFrame, n: int, halves: int, seed: int, accept: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(chain_id, step, members, accepted): many swap chains walked in step with each other, seen at ``checkpoints(halves)``.

    starts: (chain_id, members), distinct asset numbers below n. All chains of a
    batch and size take a step as a few array operations; ``accept`` gets their new
    members as a matrix, a row a chain, and says which may be taken. A chain's
    random numbers depend on seed, chain_id and step only, so batches, tasks and
    repeated runs do not matter. A start that is not accepted raises; an empty or
    full portfolio stays as it is; ``accepted`` is the share of steps taken so far.
    """
    at = checkpoints(halves)

    def walk_all(ids: np.ndarray, held: np.ndarray) -> Iterator[pd.DataFrame]:
        rows, k = np.arange(len(ids)), held.shape[1]
        inside = np.zeros((len(ids), n), bool)
        inside[rows[:, None], held] = True
        if (inside.sum(1) != k).any() or not np.all(accept(held)):
            raise ValueError("a chain starts outside the feasible set")
        free = np.nonzero(~inside)[1].reshape(len(ids), n - k)
        taken = np.zeros(len(ids), np.int64)
        for t in range(1, at[-1] + 1):
            if 0 < k < n:
                out, into = ((_uniform(seed, ids, t, which) * size).astype(np.int64) for which, size in ((0, k), (1, n - k)))
                new = held.copy()
                new[rows, out] = free[rows, into]
                ok = np.flatnonzero(accept(new))
                free[ok, into[ok]] = held[ok, out[ok]]
                held[ok] = new[ok]
                taken[ok] += 1
            if t in at:
                yield pd.DataFrame({"chain_id": ids, "step": t, "members": list(np.sort(held, axis=1)), "accepted": taken / t})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["members"].map(len)
            for _, same in batch.groupby(sizes):
                yield from walk_all(same["chain_id"].to_numpy(np.int64), np.stack([np.asarray(m, np.int64) for m in same["members"]]).reshape(len(same), -1))

    return starts.select("chain_id", "members").mapInPandas(work, "chain_id long, step long, members array<long>, accepted double")
