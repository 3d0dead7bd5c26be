"""Exact numbers of k-subsets that obey caps, count bounds and weighted rules, without listing subsets.

Assets count only by their cell: group, whole weights and number. A cell's
polynomial says in how many ways j of its assets add j to the size and j times
its weights to the sums; polynomials are multiplied by joining rows and adding up
ways. That is done as a tree: the cells of every group by pairs, all groups side
by side, then the groups by pairs, so the rounds grow with the logarithm of the
number of cells. In a product one factor's rows are dealt out by hash and the
other's are sent to each part, so no pair of factors is one task's work.

Sums that only have to reach a bound are held at it, sums that must not pass one
are dropped beyond it: that bounds a polynomial's rows whatever the universe.
Numbers of ways have no bound: they are kept as remainders for as many primes
below 2^31 as the number of all k-subsets needs, added and multiplied as longs,
and put together once, in the answer's few rows.

Defined results: assets with a null group or weight take no part; an empty
universe has one 0-subset and no other; equal assets are told apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil, comb, floor, isqrt, prod

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rulemark.operators.cuts import cut

#: Parts that one product's rows are dealt into.
PARTS = 16


@dataclass(frozen=True)
class Axis:
    """A whole weight from 0 of an asset whose sum is counted: at least ``low``, and no more than ``high`` if given."""

    weight: Column
    low: int = 0
    high: int | None = None

    def held(self, total: Column) -> Column:
        return F.least(total, F.lit(max(self.low, 0))) if self.high is None else total


def primes(bits: int) -> list[int]:
    """Primes from 2^31 down whose product has more than ``bits`` bits."""
    found, n = [], (1 << 31) - 1
    while prod(found).bit_length() <= bits + 1:
        if all(n % d for d in range(3, isqrt(n) + 1, 2)):
            found.append(n)
        n -= 2
    return found


def together(rests: Sequence[int], moduli: Sequence[int]) -> int:
    """The number below the product of the moduli with these remainders."""
    whole = prod(moduli)
    return sum(r * (whole // m) * pow(whole // m, -1, m) for r, m in zip(rests, moduli, strict=True)) % whole


def _leaves(cells: DataFrame, k: int, moduli: list[int]) -> DataFrame:
    """(grp, i, n, sums, r0, ...): every cell's polynomial; j of c equal assets in c over j ways."""

    def ways(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for grp, i, last, cap, weights, count in zip(*(frame[c] for c in ("grp", "i", "last", "cap", "weights", "count")), strict=True):
                for j in range(min(cap, k, count) + 1):
                    c = comb(count, j)
                    rows.append((grp, i, last, cap, j, [int(w) * j for w in weights], *(c % p for p in moduli)))
            yield pd.DataFrame(rows, columns=["grp", "i", "last", "cap", "n", "sums", *(f"r{m}" for m in range(len(moduli)))])

    kind = cells.schema["grp"].dataType.simpleString()
    return cells.mapInPandas(ways, f"grp {kind}, i long, last long, cap int, n int, sums array<long>, " + ", ".join(f"r{m} long" for m in range(len(moduli))))


def _kept(rows: DataFrame, axes: Sequence[Axis]) -> DataFrame:
    """Sums held at their bounds, rows beyond one dropped."""
    for a, axis in enumerate(axes):
        if axis.high is not None:
            rows = rows.where(F.get("sums", F.lit(a)) <= axis.high)
    held = [axis.held(F.get("sums", F.lit(a))) for a, axis in enumerate(axes)]
    return rows.withColumn("sums", F.array(*held) if held else F.array().cast("array<long>"))


def _added(rows: DataFrame, keys: list[str], moduli: list[int]) -> DataFrame:
    """Ways of equal keys added up; a sum of remainders stays far below 2^63."""
    return rows.groupBy(*keys).agg(*((F.sum(f"r{m}") % p).alias(f"r{m}") for m, p in enumerate(moduli)))


def _halved(rows: DataFrame, axes: Sequence[Axis], moduli: list[int]) -> DataFrame:
    """Polynomials 2i and 2i + 1 of every group multiplied; a last one without a partner passes."""
    names = [f"r{m}" for m in range(len(moduli))]
    rows = rows.withColumn("odd", F.col("i") % 2)
    alone = rows.where("odd = 0 AND i = last").drop("odd")
    part = F.pmod(F.xxhash64("n", "sums"), F.lit(PARTS))
    a = rows.where("odd = 0 AND i < last").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    b = rows.where("odd = 1").select("grp", (F.col("i") - 1).alias("i"), F.col("n").alias("m"), F.col("sums").alias("more"), *(F.col(r).alias(f"{r}b") for r in names), part.cast("int").alias("part"))
    pairs = a.join(b, ["grp", "i", "part"]).where(F.col("n") + F.col("m") <= F.col("cap"))
    product = [((F.col(r) * F.col(f"{r}b")) % p).alias(r) for r, p in zip(names, moduli, strict=True)]
    pairs = pairs.select("grp", "i", "last", "cap", (F.col("n") + F.col("m")).alias("n"), F.zip_with("sums", "more", lambda x, y: x + y).alias("sums"), *product)
    made = _kept(pairs, axes).unionByName(alone)
    made = made.withColumns({"i": F.call_function("shiftright", "i", F.lit(1)), "last": F.call_function("shiftright", "last", F.lit(1))})
    return _added(made, ["grp", "i", "last", "cap", "n", "sums"], moduli)


def _folded(rows: DataFrame, axes: Sequence[Axis], moduli: list[int], last: int) -> DataFrame:
    while last:
        rows, last = cut(_halved(rows, axes, moduli)), last >> 1
    return rows


def polynomial(assets: DataFrame, k: int, axes: Sequence[Axis], group: Column, cap: Column | int | None = None) -> tuple[DataFrame, list[int]]:
    """((sums, r0, r1, ...), primes): for k-subsets with at most ``cap`` assets of a group, ways by their sums as remainders."""
    cap = F.lit(k) if cap is None else F.least(cap if isinstance(cap, Column) else F.lit(cap), F.lit(k))
    weights = F.array(*(a.weight.cast("long") for a in axes)) if axes else F.array().cast("array<long>")
    cells = assets.select(group.alias("grp"), cap.cast("int").alias("cap"), weights.alias("weights"))
    cells = cells.where(F.col("grp").isNotNull() & F.forall("weights", lambda w: w.isNotNull())).groupBy("grp", "cap", "weights").count()
    place = Window.partitionBy("grp").orderBy("weights", "cap")  # a row a cell
    cells = cut(cells.withColumns({"i": F.row_number().over(place).cast("long") - 1, "last": F.count("*").over(Window.partitionBy("grp")) - 1}))
    size, last = cells.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("last"), F.lit(0))).first()  # one row
    moduli = primes(comb(size, k).bit_length())
    rows = _added(_kept(_leaves(cells, k, moduli), axes), ["grp", "i", "last", "cap", "n", "sums"], moduli)
    rows = _folded(cut(rows), axes, moduli, last)
    groups = cut(rows.select("grp").distinct().withColumn("i", F.monotonically_increasing_id()))
    order = Window.orderBy("i")  # a row a group
    groups = cut(groups.select("grp", (F.row_number().over(order).cast("long") - 1).alias("i")))
    n_groups = groups.count()
    rows = rows.drop("i", "last", "cap").join(groups, "grp").withColumns({"grp": F.lit(0), "last": F.lit(max(n_groups - 1, 0)).cast("long"), "cap": F.lit(k)})
    rows = _folded(cut(rows), axes, moduli, max(n_groups - 1, 0))
    return rows.where(F.col("n") == k).select("sums", *(f"r{m}" for m in range(len(moduli)))), moduli


def spelled(rows: DataFrame, keys: list[str], moduli: list[int], out: str = "ways") -> DataFrame:
    """Few rows of remainders as decimal numbers of any length."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    names = [f"r{m}" for m in range(len(moduli))]

    def spell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = frame[keys].copy()
            made[out] = [str(together(rests, moduli)) for rests in zip(*(frame[r].tolist() for r in names), strict=True)]
            yield made

    return _added(rows, keys, moduli).select(*keys, *names).mapInPandas(spell, f"{kinds}, {out} string")


def _accepted(axes: Sequence[Axis]) -> Column:
    ok = F.lit(True)
    for a, axis in enumerate(axes):
        ok = ok & (F.get("sums", F.lit(a)) >= axis.low)
    return ok


def subset_count(assets: DataFrame, k: int, axes: Sequence[Axis], group: Column, cap: Column | int | None = None) -> DataFrame:
    """One row (ways): the number of k-subsets that obey everything, as a decimal number."""
    rows, moduli = polynomial(assets, k, axes, group, cap)
    # No asset at all: the polynomial has no rows, and the one empty set is counted here.
    one = int(k == 0 and all(a.low <= 0 for a in axes) and not rows.limit(1).count())
    names = [f"r{m}" for m in range(len(moduli))]
    rows = rows.where(_accepted(axes)).select(F.lit(0).alias("all"), *names)
    base = assets.sparkSession.range(1).select(F.lit(0).alias("all"), *(F.lit(one).cast("long").alias(r) for r in names))
    return spelled(rows.unionByName(base), ["all"], moduli).select("ways")


def score_counts(assets: DataFrame, k: int, score: Column, group: Column, cap: Column | int | None = None, most: int = 1 << 31) -> DataFrame:
    """(total, ways): the number of k-subsets with each total score."""
    rows, moduli = polynomial(assets, k, [Axis(score, 0, most)], group, cap)
    rows = rows.withColumn("total", F.get("sums", F.lit(0)))
    return spelled(rows, ["total"], moduli)


@dataclass(frozen=True)
class Mean:
    """A bound on the equal-weight mean of a column: at least ``bound``, at most, or (strict) truly below it."""

    column: str
    bound: float
    at_least: bool = True
    strict: bool = False


def share_below(assets: DataFrame, k: int, rules: Sequence[Mean], fund: Mean, bins: int, group: Column, cap: Column | int | None = None, bounds: Sequence[Axis] = ()) -> DataFrame:
    """One row: of the k-subsets that obey ``rules``, ``bounds`` and caps, the share that also obeys ``fund``, with bounds that hold the true share.

    Columns come in ``bins`` whole steps of their range; each asset is off by half
    a step at most, a subset by k halves. Thresholds eased and tightened by that
    count supersets and subsets of the true ones: low = fewest with the fund's
    rule by most without, high the other way round, share as if steps were exact. All
    three come from one polynomial, held at the tightest thresholds.
    """
    means = [*rules, fund]
    ends = assets.agg(*(x for m in means for x in (F.min(m.column), F.max(m.column)))).first()  # one row
    axes, cuts = list(bounds), []
    for a, m in enumerate(means):
        low, high = float(ends[2 * a] or 0), float(ends[2 * a + 1] or 0)
        scale = (bins - 1) / (high - low) if high > low else 1.0
        value = F.col(m.column).cast("double")
        step = F.round(scale * (value - low if m.at_least else high - value))
        need = scale * k * (m.bound - low if m.at_least else high - m.bound)
        cuts.append(thresholds(need, k, m.strict))
        axes.append(Axis(step, max(cuts[-1][2], 0)))
    rows, moduli = polynomial(assets, k, axes, group, cap)
    rows = rows.where(_accepted(list(bounds)))
    reached = lambda a, mode: F.get("sums", F.lit(len(bounds) + a)) >= cuts[a][mode]
    flags = {}
    for mode, name in enumerate(("eased", "plain", "tight")):
        ruled = F.lit(True)
        for a in range(len(rules)):
            ruled = ruled & reached(a, mode)
        flags |= {f"{name}_ruled": ruled, f"{name}_both": ruled & reached(len(rules), mode)}
    names = list(flags)
    told = spelled(rows.withColumns(flags), names, moduli)  # 64 rows at most

    def ratio(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = dict.fromkeys(names, 0)
        for frame in frames:
            for name in names:
                n[name] += sum(int(w) for w, on in zip(frame["ways"], frame[name], strict=True) if on)
        over = lambda a, b, none: min(n[a] / n[b], 1.0) if n[b] else none
        yield pd.DataFrame([{
            "ruled": str(n["plain_ruled"]), "below": str(n["plain_both"]), "low": over("tight_both", "eased_ruled", 0.0),
            "share": over("plain_both", "plain_ruled", None), "high": over("eased_both", "tight_ruled", 1.0),
        }])

    return told.coalesce(1).mapInPandas(ratio, "ruled string, below string, low double, share double, high double")


def thresholds(need: float, k: int, strict: bool) -> tuple[int, int, int]:
    """Whole thresholds for a sum of k rounded weights whose true value must reach (strict: pass) ``need``: eased, plain, tight."""
    at = lambda x: floor(x + 1e-9) + 1 if strict else ceil(x - 1e-9)
    return at(need - k / 2), at(need), at(need + k / 2)
