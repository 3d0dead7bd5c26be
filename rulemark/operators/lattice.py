"""Weight lattices and states under single swaps."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemark.operators.cuts import cut


@dataclass(frozen=True)
class Grid:
    """Portfolios of ``n`` assets in whole units that add up to ``units``: k_min to k_max assets held, each with low to high units."""

    n: int
    units: int
    low: int
    high: int
    k_min: int
    k_max: int

    def __post_init__(self) -> None:
        if not (1 <= self.low <= self.high and self.units >= 1 and 1 <= self.k_min <= self.k_max <= self.n):
            raise ValueError(f"no such grid: {self}")

    @property
    def choices(self) -> list[int]:
        """What one asset may hold."""
        return [0, *range(self.low, self.high + 1)]

    @cached_property
    def completions(self) -> list[dict[tuple[int, int], int]]:
        """For each asset i: ways to fill assets i and later, by (units left, assets held so far); exact integers."""
        ways = [{(0, held): 1 for held in range(self.k_min, self.k_max + 1)}]
        for _ in range(self.n):
            states = ((rest, held) for rest in range(self.units + 1) for held in range(self.k_max + 1))
            ways.append({at: found for at in states if (found := sum(ways[-1].get((at[0] - q, at[1] + (q > 0)), 0) for q in self.choices))})
        return ways[::-1]

    @property
    def size(self) -> int:
        """The number of points."""
        return self.completions[0].get((self.units, 0), 0)

    def contains(self, point: Column) -> Column:
        """Whether an array of units is a point of the grid."""
        held = F.filter(point, lambda q: q != 0)
        total = F.aggregate(point, F.lit(0).cast("long"), lambda a, q: a + q)
        return (F.size(point) == self.n) & (total == self.units) & F.size(held).between(self.k_min, self.k_max) & F.forall(held, lambda q: q.between(self.low, self.high))


def _state(rest: Column, held: Column, grid: Grid) -> Column:
    return rest * (grid.k_max + 1) + held


def _by_state(grid: Grid, i: int, of) -> Column:
    """A literal array over the states before asset i."""
    states = ((rest, held) for rest in range(grid.units + 1) for held in range(grid.k_max + 1))
    rows = (", ".join(f"{x}L" for x in of(rest, held, grid.completions[i + 1])) for rest, held in states)
    return F.expr(f"array({', '.join(f'array({row})' for row in rows)})")


def points(spark: SparkSession, grid: Grid) -> DataFrame:
    """All points of the grid (point: array<int>); branches without a completion are never opened."""
    rows = spark.range(1).select(F.array().cast("array<int>").alias("point"), F.lit(grid.units).alias("rest"), F.lit(0).alias("held"))
    for i in range(grid.n):
        open_ = _by_state(grid, i, lambda rest, held, ways: [q for q in grid.choices if (rest - q, held + (q > 0)) in ways])
        rows = rows.withColumn("q", F.explode(F.get(open_, _state(F.col("rest"), F.col("held"), grid)))).withColumn("q", F.col("q").cast("int"))
        rows = rows.select(F.concat("point", F.array("q")).alias("point"), (F.col("rest") - F.col("q")).alias("rest"), (F.col("held") + (F.col("q") > 0).cast("int")).alias("held"))
    return rows.where((F.col("rest") == 0) & (F.col("held") >= grid.k_min)).select("point")


def nth_point(rows: DataFrame, index: str, grid: Grid, out: str = "point") -> DataFrame:
    """rows with the grid's point number ``index`` (from 0, points in lexicographic order).

    An index drawn uniformly gives a uniform point: no point is rejected and none
    is listed. Numbers outside the grid give null.
    """
    if grid.size >= 1 << 63:
        raise ValueError("the grid has more points than a long counts")
    rows = rows.withColumns({"_left": F.col(index).cast("long"), "_rest": F.lit(grid.units), "_held": F.lit(0), "_point": F.array().cast("array<int>")})

    def running(rest: int, held: int, ways: dict) -> list[int]:
        found, total = [], 0
        for q in grid.choices:
            total += ways.get((rest - q, held + (q > 0)), 0)
            found.append(total)
        return found

    for i in range(grid.n):
        rows = rows.withColumn("_sums", F.get(_by_state(grid, i, running), _state(F.col("_rest"), F.col("_held"), grid)))
        rows = rows.withColumn("_pick", F.size(F.filter("_sums", lambda x: x <= F.col("_left"))))
        q = F.when(F.col("_pick") == 0, 0).otherwise(F.col("_pick") + grid.low - 1)
        rows = rows.withColumn("_q", q).withColumns({
            "_left": F.col("_left") - F.coalesce(F.get("_sums", F.col("_pick") - 1), F.lit(0)),
            "_point": F.concat("_point", F.array("_q")), "_rest": F.col("_rest") - F.col("_q"), "_held": F.col("_held") + (F.col("_q") > 0).cast("int"),
        })
    inside = F.col(index).between(0, grid.size - 1)
    return rows.withColumn(out, F.when(inside, F.col("_point"))).drop("_left", "_rest", "_held", "_point", "_sums", "_pick", "_q")


def _without_one(states: DataFrame, code: str, bits: int) -> DataFrame:
    """Each state once for every member: what remains without it. States of one size that share a remainder differ by one swap."""
    members = F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: F.getbit(code, b) == 1)
    removed = F.transform(members, lambda b: F.col(code).bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    return states.withColumn("_rest", F.explode(removed))


def swap_components(states: DataFrame, bits: int, code: str = "code", out: str = "component") -> DataFrame:
    """states (distinct codes of at most ``bits`` bits) with the smallest code that single swaps reach.

    Labels sink to the smallest along shared remainders, an equi join in place of
    pairs of states, and jump to their label's label; rounds until none changes.
    The empty set has no swap and stays alone.
    """
    at = cut(states.withColumn(out, F.col(code)))
    while True:
        by_rest = _without_one(at.select(code, out), code, bits)
        low = by_rest.groupBy("_rest").agg(F.min(out).alias("_low"))
        near = by_rest.join(low, "_rest").groupBy(code).agg(F.min("_low").alias("_near"))
        after = at.join(near, code, "left").withColumn("_new", F.least(out, F.coalesce("_near", F.col(out))))
        jump = after.select(F.col(code).alias("_new"), F.col("_new").alias("_far"))
        after = cut(after.join(jump, "_new", "left").select(*at.columns, F.least("_new", "_far").alias("_to")))
        moved = after.where(F.col("_to") != F.col(out)).limit(1).count()
        at = after.withColumn(out, F.col("_to")).drop("_to")
        if not moved:
            return at


def swap_degrees(states: DataFrame, bits: int, code: str = "code", out: str = "degree") -> DataFrame:
    """states with the number of other states one swap away; two states share one remainder at most."""
    by_rest = _without_one(states.select(code), code, bits)
    others = by_rest.groupBy("_rest").agg((F.count("*") - 1).alias("_others"))
    degree = by_rest.join(others, "_rest").groupBy(code).agg(F.sum("_others").alias(out))
    return states.join(degree, code, "left").withColumn(out, F.coalesce(out, F.lit(0)))
