"""Exact extremes of portfolios in whole units under linear rules, and what makes rules contradict.

A case is a set of names, each with a whole value per unit and a range of units
that it may hold; a portfolio fills ``units`` with k_min to k_max of them. A rule
bounds a sum of whole coefficients, per unit held or per name held: weights of
groups, weighted averages (coefficient minus bound), counts of members, equal
averages. All cases are searched at once. The frontier is a DataFrame: a row a
case and state (units left, names held, running sums of the rules), with the
least and greatest value that reach it and how. A round opens one name of every
case; states that meet are merged by an aggregation, and branches are cut where
no completion can obey: for every case, name and number of units left, tables
say how far each sum, the count and the value can still go, as if each rule were
alone (a knapsack relaxation). A first, narrow search may give values that are
reached; the full one then leaves what can beat neither.

Defined results: a case without names, or that no portfolio fits, has feasible
false and nulls; a null bound is no bound; names with null values or
coefficients are no names; a null in
a case's key makes no case; equal extremes are shown by the portfolio that comes
first (least) or last (greatest) as an array, names ordered by value, then name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rulemark.operators.cuts import cut

#: Rounds between cuts of the lineage.
EVERY = 4


@dataclass(frozen=True)
class Shape:
    """Portfolios of ``units`` units in k_min to k_max names."""

    units: int
    k_min: int
    k_max: int


@dataclass(frozen=True)
class Linear:
    """low <= sum of per_unit * units + per_name * (units > 0) <= high; columns over names, whole numbers; bounds may be columns of the case."""

    name: str
    per_unit: Column | int = 0
    per_name: Column | int = 0
    low: Column | int | None = None
    high: Column | int | None = None


def _long(c: Column | int | None) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("long")


def prepared(names: DataFrame, by: Sequence[str], rules: Sequence[Linear], name: str = "name", value: str = "value", low: str = "low", high: str = "high") -> DataFrame:
    """A row a case: its names in order (value, low, high, coefficients of the rules) and the rules' bounds."""
    coefficient = lambda of: F.array(*(_long(of(r)) for r in rules)) if rules else F.array().cast("array<long>")
    rows = names.select(
        *by, F.col(name).alias("name"), _long(F.col(value)).alias("value"), F.col(low).cast("int").alias("low"), F.col(high).cast("int").alias("high"),
        coefficient(lambda r: r.per_unit).alias("per_unit"), coefficient(lambda r: r.per_name).alias("per_name"),
        coefficient(lambda r: r.low).alias("least"), coefficient(lambda r: r.high).alias("most"),
    )
    whole = lambda c: F.forall(c, lambda x: x.isNotNull())
    rows = rows.where(F.col("value").isNotNull() & whole("per_unit") & whole("per_name") & (F.col("low") >= 1) & (F.col("low") <= F.col("high")))
    entry = F.struct("value", "name", "low", "high", "per_unit", "per_name")
    return rows.groupBy(*by).agg(F.sort_array(F.collect_list(entry)).alias("names"), F.first("least").alias("least"), F.first("most").alias("most"))


def _reach(choices: list[np.ndarray], gains: list[np.ndarray], units: int, sign: int) -> np.ndarray:
    """For each number of names dealt with from the end: the greatest (sign 1) or least (-1) total of exactly u units; NaN where none is."""
    table = np.full((len(choices) + 1, units + 1), -np.inf)
    table[-1, 0] = 0
    for i in range(len(choices) - 1, -1, -1):
        for q, gain in zip(choices[i], gains[i], strict=True):
            if q <= units:
                table[i, q:] = np.maximum(table[i, q:], table[i + 1, : units + 1 - q] + sign * gain)
    return np.where(np.isfinite(table), sign * table, np.nan)


def _tables(cases: DataFrame, by: Sequence[str], shape: Shape) -> DataFrame:
    """A row a case and name: what the name adds, and for every number of units left after it how far value, count and each sum can go."""
    kinds = ", ".join(f"{cases.schema[c].name} {cases.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{kinds}, at int, value long, low int, high int, per_unit array<long>, per_name array<long>, up array<array<double>>, down array<array<double>>"

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                names = row["names"]
                choices = [np.concatenate([[0], np.arange(n["low"], n["high"] + 1)]) for n in names]
                sums = [[n["value"] * q for n, q in zip(names, choices, strict=True)], [(q > 0).astype(float) for q in choices]]
                for r in range(len(row["least"])):
                    sums.append([n["per_unit"][r] * q + n["per_name"][r] * (q > 0) for n, q in zip(names, choices, strict=True)])
                up, down = ([_reach(choices, gains, shape.units, sign) for gains in sums] for sign in (1, -1))
                out = [{**{c: row[c] for c in by}, "at": i, **{k: n[k] for k in ("value", "low", "high", "per_unit", "per_name")},
                        "up": [t[i + 1].tolist() for t in up], "down": [t[i + 1].tolist() for t in down]} for i, n in enumerate(names)]
                yield pd.DataFrame(out)

    return cases.mapInPandas(work, schema).join(cases.select(*by, "least", "most"), list(by))


def _bounded(sums: Column, shift: Column, bound: Column, above: bool) -> Column:
    """Whether every sum plus its shift stays on the right side of its bound; null bounds hold nothing."""
    reached = F.zip_with(sums, shift, lambda s, t: s + t)
    return F.forall(F.zip_with(reached, bound, lambda x, b: F.coalesce(x >= b if above else x <= b, F.lit(True))), lambda x: x)


def _opened(frontier: DataFrame, steps: DataFrame, by: Sequence[str], shape: Shape) -> DataFrame:
    """The frontier after one more name of every case; finished cases pass."""
    rows = frontier.join(steps, list(by), "left").withColumn("open", F.col("at").isNotNull())
    choices = F.when(F.col("open"), F.concat(F.array(F.lit(0)), F.sequence("low", "high"))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("q", F.explode(F.filter(choices, lambda q: q <= F.col("left"))))
    q, holds = F.col("q"), (F.col("q") > 0).cast("int")
    rows = rows.withColumns({"left": F.col("left") - q, "held": F.col("held") + holds})
    gain = F.coalesce(F.col("value") * q, F.lit(0).cast("long"))
    sums = F.zip_with("sums", F.zip_with("per_unit", "per_name", lambda a, b: a * q + b * holds), lambda s, x: s + x)
    rows = rows.withColumn("sums", F.when(F.col("open"), sums).otherwise(F.col("sums")))
    step = lambda end: F.struct((F.col(end)["value"] + gain).alias("value"), F.when(F.col("open"), F.concat(F.col(end)["point"], F.array(q))).otherwise(F.col(end)["point"]).alias("point"))
    rows = rows.withColumns({"lowest": step("lowest"), "highest": step("highest")})
    # What is left to reach: per case and number of units, value first, count second, then the rules.
    up, down = (F.transform(c, lambda t: F.get(t, F.col("left"))) for c in ("up", "down"))
    rows = rows.withColumns({"up": up, "down": down})
    n = F.size("sums")
    can = F.coalesce(~F.isnan(F.get("up", F.lit(0))), F.lit(False)) & (F.col("held") + F.get("down", F.lit(1)) <= shape.k_max) & (F.col("held") + F.get("up", F.lit(1)) >= shape.k_min)
    can = can & _bounded(F.col("sums"), F.slice("up", 3, n), F.col("least"), True) & _bounded(F.col("sums"), F.slice("down", 3, n), F.col("most"), False)
    better = (F.col("highest")["value"] + F.get("up", F.lit(0)) >= F.col("least_wanted")) | (F.col("lowest")["value"] + F.get("down", F.lit(0)) <= F.col("most_wanted"))
    return rows.where(~F.col("open") | (can & F.coalesce(better, F.lit(True))))


def _merged(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    key = [*by, "left", "held", "sums"]
    return rows.groupBy(*key).agg(F.min("lowest").alias("lowest"), F.max("highest").alias("highest"), F.first("least_wanted").alias("least_wanted"), F.first("most_wanted").alias("most_wanted"))


def _search(cases: DataFrame, steps: DataFrame, by: Sequence[str], shape: Shape, rounds: int, beam: int | None = None, reached: DataFrame | None = None) -> DataFrame:
    """Cases with (lowest, highest): structs of value and point. ``beam`` keeps that many states a case and round, so finds values reached, not extremes."""
    none = F.lit(None).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("value"), F.array().cast("array<int>").alias("point"))
    rows = cases.select(*by, F.lit(shape.units).alias("left"), F.lit(0).alias("held"), F.transform("least", lambda x: F.lit(0).cast("long")).alias("sums"), start.alias("lowest"), start.alias("highest"))
    if reached is None:
        rows = rows.withColumns({"least_wanted": none, "most_wanted": none})
    else:
        rows = rows.join(reached.select(*by, F.col("highest.value").alias("least_wanted"), F.col("lowest.value").alias("most_wanted")), list(by), "left")
    for i in range(rounds):
        rows = _opened(rows, steps.where(F.col("at") == i), by, shape)
        if beam:
            low = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("lowest.value") + F.coalesce(F.get("down", F.lit(0)), F.lit(0.0)), "left", "held", "sums"))
            high = F.row_number().over(Window.partitionBy(*by).orderBy((F.col("highest.value") + F.coalesce(F.get("up", F.lit(0)), F.lit(0.0))).desc(), "left", "held", "sums"))
            rows = rows.withColumns({"by_low": low, "by_high": high}).where((F.col("by_low") <= beam) | (F.col("by_high") <= beam))
        rows = _merged(rows, by)
        if i % EVERY == EVERY - 1 and i < rounds - 1:
            rows = cut(rows)
    # A case without names has opened nothing: its sums are zero and its units are left.
    ends = rows.where(F.col("left") == 0).join(cases.select(*by, "least", "most"), list(by))
    zero = F.transform("sums", lambda s: F.lit(0).cast("double"))
    obey = _bounded(F.col("sums"), zero, F.col("least"), True) & _bounded(F.col("sums"), zero, F.col("most"), False)
    ends = ends.where((F.col("held") >= shape.k_min) & (F.col("held") <= shape.k_max) & obey)
    return ends.groupBy(*by).agg(F.min("lowest").alias("lowest"), F.max("highest").alias("highest"))


def extremes(names: DataFrame, by: Sequence[str], rules: Sequence[Linear], shape: Shape, beam: int | None = None, **columns: str) -> DataFrame:
    """A row a case: feasible, and the least and greatest total value (lowest, highest) with the units held of each name in argmin and argmax.

    ``names`` holds by, name, value, low and high (``columns`` names them); every
    rule's coefficients and bounds are columns over it, bounds equal in a case.
    """
    names = names.dropna(subset=list(by))
    cases = cut(prepared(names, by, rules, **columns))
    steps = cut(_tables(cases, by, shape))
    rounds = cases.agg(F.coalesce(F.max(F.size("names")), F.lit(0))).first()[0]  # one number
    reached = cut(_search(cases, steps, by, shape, rounds, beam=beam)) if beam else None
    found = _search(cases, steps, by, shape, rounds, reached=reached)
    found = names.select(*by).distinct().join(cases.select(*by, F.col("names.name").alias("order")), list(by), "left").join(found, list(by), "left")
    shown = lambda end: F.filter(F.zip_with("order", F.col(end)["point"], lambda n, q: F.struct(n.alias("name"), q.alias("units"))), lambda s: s["units"] > 0)
    return found.select(
        *by, F.col("lowest").isNotNull().alias("feasible"), F.col("lowest")["value"].alias("lowest"), F.col("highest")["value"].alias("highest"),
        F.sort_array(shown("lowest")).alias("argmin"), F.sort_array(shown("highest")).alias("argmax"),
    )


def feasible(names: DataFrame, by: Sequence[str], rules: Sequence[Linear], shape: Shape, **columns: str) -> DataFrame:
    """(by, feasible): whether any portfolio obeys, values left aside."""
    value = columns.get("value", "value")
    return extremes(names.withColumn(value, F.lit(0)), by, rules, shape, **columns).select(*by, "feasible")


def _without(rule: Linear, dropped: Column) -> Linear:
    open_ = lambda bound: None if bound is None else F.when(~dropped, _long(bound))
    return Linear(rule.name, rule.per_unit, rule.per_name, open_(rule.low), open_(rule.high))


def diagnose(names: DataFrame, by: Sequence[str], rules: Sequence[Linear], shape: Shape, **columns: str) -> DataFrame:
    """A row a case: feasible, and relief, the names of the rules each of which makes an infeasible case feasible if it alone is lifted.

    The case as it is and with each rule lifted are searched together, as cases of one frontier.
    """
    tried = names.withColumn("lifted", F.explode(F.array(F.lit(""), *(F.lit(r.name) for r in rules))))
    found = feasible(tried, [*by, "lifted"], [_without(r, F.col("lifted") == r.name) for r in rules], shape, **columns)
    whole = F.max(F.when(F.col("lifted") == "", F.col("feasible")))
    relief = F.sort_array(F.collect_list(F.when((F.col("lifted") != "") & F.col("feasible"), F.col("lifted"))))
    out = found.groupBy(*by).agg(whole.alias("feasible"), relief.alias("relief"))
    return out.withColumn("relief", F.when(F.col("feasible"), F.array().cast("array<string>")).otherwise(F.col("relief")))


def contradiction(names: DataFrame, by: Sequence[str], rules: Sequence[Linear], shape: Shape, **columns: str) -> DataFrame:
    """A row an infeasible case: conflict, a set of rules that contradict each other and none of which can be spared.

    A deletion filter for all cases at once: rule by rule, in order, one is lifted
    for good wherever the case stays infeasible without it.
    """
    lifted = cut(diagnose(names, by, rules, shape, **columns).where("NOT feasible").select(*by, F.array().cast("array<string>").alias("lifted")))
    rows = names.join(lifted.select(*by), list(by), "left_semi")
    for rule in rules:
        now = rows.join(lifted, list(by)).withColumn("lifted", F.concat("lifted", F.array(F.lit(rule.name))))
        tried = feasible(now, [*by, "lifted"], [_without(r, F.array_contains("lifted", r.name)) for r in rules], shape, **columns)
        tried = tried.select(*by, F.when(F.col("feasible"), F.slice("lifted", 1, F.size("lifted") - 1)).otherwise(F.col("lifted")).alias("lifted"))
        lifted = cut(tried)
    every = F.array(*(F.lit(r.name) for r in rules)) if rules else F.array().cast("array<string>")
    return lifted.select(*by, F.array_except(every, "lifted").alias("conflict"))
