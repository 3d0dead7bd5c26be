"""Greedy repair of portfolios that break selection rules, all at once.

A portfolio's violation adds up, each in its own scale: how far its size is from
k, names over a group's cap, banned names, and how far averages miss their
bounds. A round makes each portfolio's best single move: names are added or
dropped until the size is right, then one is swapped for another; a portfolio
that no move improves is given up and left as it came.

Not every name of the universe is tried. Of two names with the same groups and
ban, one that is no worse in any average is no worse a move, and a portfolio
holds at most ``held`` names, so only names that fewer than ``held + 1`` others
of their kind dominate can be the best (their skyband, found by blocks, then
once more over the blocks' results). Ties go to the better averages in the
rules' order, then the smaller ids, which agrees with that cut: results equal a
search of all names. A round joins portfolios still being repaired with this
short list, takes the least move in one aggregation, and cuts its lineage.

Repair favours names that are good by the rules, so repaired portfolios are not
uniform: report their share. Defined results: portfolios that obey come back
unchanged (``kept``); an empty one misses every average by 1; a null attribute
makes a name banned from being added, and where held counts as the worst value;
names held but not in the universe are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulemark.operators.cuts import cut

#: Digits to which violations are compared, so that the order of a sum does not matter.
DIGITS = 9
#: Names of one kind that one task compares with each other at first.
BLOCK = 4096
#: Names on the short list up to which it is broadcast.
SHORT = 50_000


@dataclass(frozen=True)
class Average:
    """A bound on the mean of a column over held names: at least or at most."""

    column: str
    bound: float
    at_least: bool = True


@dataclass(frozen=True)
class Rules:
    """k names; caps: most names of a group (a predicate over the universe by name); banned: a predicate; averages."""

    k: int | None = None
    caps: dict[str, tuple[Column, int]] = field(default_factory=dict)
    banned: Column | None = None
    averages: Sequence[Average] = ()


def _profiles(universe: DataFrame, rules: Rules, asset: str) -> DataFrame:
    """(asset, groups, banned, good): group flags, ban, and averages turned so that more is better."""
    groups = F.array(*(F.coalesce(c, F.lit(False)).cast("int") for c, _ in rules.caps.values())) if rules.caps else F.array().cast("array<int>")
    banned = F.coalesce(rules.banned, F.lit(False)).cast("int") if rules.banned is not None else F.lit(0)
    turned = [(F.col(a.column) if a.at_least else -F.col(a.column)).cast("double") for a in rules.averages]
    good = F.array(*turned) if turned else F.array().cast("array<double>")
    return universe.select(F.col(asset).alias("asset"), groups.alias("groups"), banned.alias("banned"), good.alias("good")).where("asset IS NOT NULL")


def _skyband(frame: pd.DataFrame, most: int) -> pd.DataFrame:
    """Rows that at most ``most`` others dominate; ``good`` no less in any place, equal ones by smaller id."""
    rows = sorted(zip(frame["good"].map(list), frame["asset"], range(len(frame)), strict=True), key=lambda r: ([-x for x in r[0]], r[1]))
    kept: list[tuple] = []
    for row in rows:
        over = sum(all(x >= y for x, y in zip(r[0], row[0], strict=True)) for r in kept)
        if over <= most:
            kept.append(row)
    return frame.iloc[[r[2] for r in kept]]


def short_list(profiles: DataFrame, most: int) -> DataFrame:
    """The profiles that can be a best move: by kind, those that at most ``most`` others dominate, blocks first."""
    able = profiles.where(~F.exists("good", lambda x: x.isNull()))
    kind = ["groups", "banned"]
    cut_ = lambda df: df.groupBy(*[c for c in df.columns if c in (*kind, "block")]).applyInPandas(lambda f: _skyband(f, most), df.schema)
    sizes = able.groupBy(*kind).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = able.join(sizes, kind).withColumn("block", F.pmod(F.xxhash64("asset"), F.col("blocks"))).drop("blocks")
    return cut_(cut_(dealt).drop("block"))


def _violation(rules: Rules, n: Column, groups: Column, banned: Column, good: Column, scales: Sequence[float]) -> Column:
    total = banned.cast("double")
    if rules.k is not None:
        total = total + F.abs(n - rules.k) / max(rules.k, 1)
    for i, (_, cap) in enumerate(rules.caps.values()):
        total = total + F.greatest(F.get(groups, F.lit(i)) - cap, F.lit(0)) / max(cap, 1)
    for i, a in enumerate(rules.averages):
        gap = (a.bound if a.at_least else -a.bound) - F.try_divide(F.get(good, F.lit(i)), n)
        total = total + F.when(n > 0, F.greatest(gap, F.lit(0.0)) / scales[i]).otherwise(1.0)
    return F.round(total, DIGITS)


def _sum(array: str, size: int, kind: str) -> Column:
    parts = [F.coalesce(F.sum(F.get(F.col(array), F.lit(i))), F.lit(0)).cast(kind) for i in range(size)]
    return F.array(*parts) if parts else F.array().cast(f"array<{kind}>")


def _state(held: DataFrame, ids: DataFrame, rules: Rules, scales: Sequence[float], sample: str) -> DataFrame:
    """A row a portfolio: its names, sums and violation; ids keeps portfolios without a name."""
    sums = held.groupBy(sample).agg(
        F.count("*").cast("int").alias("n"), F.collect_list("asset").alias("names"), _sum("groups", len(rules.caps), "int").alias("g"), F.sum("banned").cast("int").alias("b"), _sum("good", len(rules.averages), "double").alias("s")
    )
    zero = {"n": F.lit(0), "names": F.array().cast(sums.schema["names"].dataType), "g": F.array(*[F.lit(0)] * len(rules.caps)).cast("array<int>"), "b": F.lit(0), "s": F.array(*[F.lit(0.0)] * len(rules.averages)).cast("array<double>")}
    rows = ids.join(sums, sample, "left").select(sample, *(F.coalesce(c, d).alias(c) for c, d in zero.items()))
    return rows.withColumn("violation", _violation(rules, F.col("n"), F.col("g"), F.col("b"), F.col("s"), scales))


def _best(state: DataFrame, held: DataFrame, listed: DataFrame, rules: Rules, scales: Sequence[float], sample: str) -> DataFrame:
    """(sample, move): the least (violation, what comes in, what goes out) of every portfolio's moves."""
    go = F.struct(F.col("asset").alias("out"), F.col("groups").alias("og"), F.col("banned").alias("ob"), F.col("good").alias("os"))
    goes = held.select(sample, go.alias("go"))
    nothing = F.lit(None).cast(held.select(go.alias("go")).schema["go"].dataType)
    size = F.lit(0) if rules.k is None else F.signum(F.col("n") - rules.k)
    state = state.withColumn("way", size)
    # Too many names: one goes. Too few: one comes. Else one for one; without k also one alone.
    leave = state.join(goes, sample).where("way >= 0")
    stay = state.where("way < 0" if rules.k is not None else "true").withColumn("go", nothing)
    comes = F.struct(F.col("asset").alias("into"), F.col("groups").alias("ig"), F.col("banned").alias("ib"), F.col("good").alias("is")).alias("come")
    none = F.lit(None).cast(listed.select(comes).schema["come"].dataType)
    alone = leave.where("way > 0" if rules.k is not None else "true").withColumn("come", none)
    both = leave.where("way = 0").unionByName(stay).crossJoin(listed.select(comes)).where(~F.array_contains("names", F.col("come.into")))
    moves = both.unionByName(alone)
    delta = lambda now, plus, minus, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(now, i) + F.coalesce(F.get(plus, i), F.lit(0)) - F.coalesce(F.get(minus, i), F.lit(0))) if n else now
    n = F.col("n") + F.col("come").isNotNull().cast("int") - F.col("go").isNotNull().cast("int")
    groups = delta(F.col("g"), F.col("come.ig"), F.col("go.og"), len(rules.caps))
    good = delta(F.col("s"), F.col("come.is"), F.col("go.os"), len(rules.averages))
    banned = F.col("b") + F.coalesce("come.ib", F.lit(0)) - F.coalesce("go.ob", F.lit(0))
    moves = moves.select(sample, "violation", "come.into", "come.is", "go.out", n.alias("n"), groups.alias("g"), banned.alias("b"), good.alias("s"))
    after = _violation(rules, F.col("n"), F.col("g"), F.col("b"), F.col("s"), scales)
    worst = F.transform("is", lambda x: -x)
    move = F.struct(after.alias("after"), worst.alias("worse"), "into", "out")
    best = moves.groupBy(sample).agg(F.min(move).alias("move"), F.first("violation").alias("before"))
    if rules.k is None:
        return best.where(F.col("move.after") < F.col("before"))
    # Moves towards the size k are made whatever else they cost; swaps must improve.
    return best.join(state.select(sample, "way"), sample).where((F.col("way") != 0) | (F.col("move.after") < F.col("before")))


def repair(held: DataFrame, universe: DataFrame, rules: Rules, samples: DataFrame | None = None, sample: str = "sample_id", asset: str = "asset_id", max_steps: int = 100) -> tuple[DataFrame, DataFrame]:
    """(portfolios, report): the held names after repair, and a row a portfolio with violation before and after, steps and outcome.

    outcome: kept, repaired, or failed (its names are then as they came). ``samples``
    names portfolios that may hold nothing.
    """
    profiles = cut(_profiles(universe, rules, asset))
    at = lambda i: F.get("good", F.lit(i))
    spread = [x for i in range(len(rules.averages)) for x in (F.max(at(i)) - F.min(at(i)), F.min(at(i)))]
    found = profiles.agg(F.count("*"), *spread).first()  # one row
    scales = [max(found[1 + 2 * i] or 0.0, 1e-12) for i in range(len(rules.averages))]
    worst = [found[2 + 2 * i] or 0.0 for i in range(len(rules.averages))]
    ids = cut((samples if samples is not None else held).select(sample).distinct())
    known = profiles.withColumn("good", F.transform("good", lambda x, i: F.coalesce(x, F.get(F.array(*map(F.lit, worst)) if worst else F.array().cast("array<double>"), i))))
    first = cut(held.select(sample, F.col(asset).alias("asset")).distinct().join(known, "asset"))
    state = cut(_state(first, ids, rules, scales, sample))
    largest = state.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]  # one number: the most names held
    listed = cut(short_list(profiles, max(largest, rules.k or 0)))
    if listed.count() <= SHORT:
        listed = F.broadcast(listed)
    before = state.select(sample, F.col("violation").alias("before"))
    now, open_, done = first, state.where("violation > 0"), None
    steps = 0
    while open_.limit(1).count():
        if steps == max_steps:
            break
        steps += 1
        best = cut(_best(open_, now.join(open_.select(sample), sample, "left_semi"), listed, rules, scales, sample).select(sample, "move.into", "move.out"))
        stuck = open_.join(best, sample, "left_anti").select(sample, F.lit("failed").alias("outcome"), F.lit(steps - 1).alias("steps"))
        gone = best.where("out IS NOT NULL").select(sample, F.col("out").alias("asset"))
        come = best.where("into IS NOT NULL").select(sample, F.col("into").alias("asset")).join(known, "asset").select(*now.columns)
        now = cut(now.join(gone, [sample, "asset"], "left_anti").unionByName(come))
        # Only portfolios that moved are looked at again.
        state = cut(_state(now.join(best.select(sample), sample, "left_semi"), best.select(sample), rules, scales, sample))
        fine = state.where("violation = 0").select(sample, F.lit("repaired").alias("outcome"), F.lit(steps).alias("steps"))
        ended = stuck.unionByName(fine)
        done = cut(ended if done is None else done.unionByName(ended))
        open_ = state.where("violation > 0")
    late = open_.select(sample, F.lit("failed").alias("outcome"), F.lit(steps).alias("steps"))
    done = late if done is None else done.unionByName(late)
    report = before.join(done, sample, "left").select(sample, "before", F.coalesce("steps", F.lit(0)).alias("steps"), F.coalesce("outcome", F.lit("kept")).alias("outcome"))
    failed = report.where("outcome = 'failed'").select(sample)
    names = now.join(failed, sample, "left_anti").unionByName(first.join(failed, sample, "left_semi"))
    ends = ids.join(failed, sample, "left_semi").join(before, sample).select(sample, F.col("before").alias("after"))
    report = report.join(ends, sample, "left").withColumn("after", F.coalesce("after", F.lit(0.0)))
    return names.select(sample, F.col("asset").alias(asset)), report.select(sample, "before", "after", "steps", "outcome")
