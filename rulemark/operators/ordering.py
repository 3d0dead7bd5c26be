"""Global ranks and running sums of a whole table, without one task that holds it.

Rows are dealt to ranges of the order, sorted within them and written; a range's
size and sums are one row a range, from which each range gets what comes before it.
Ties are in no set order unless ``order`` tells rows apart. Nulls come first.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rulemark.operators.cuts import cut

_PLACE = (1 << 33) - 1


def _dealt(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """df by ranges, with the place of each row: its range's number and its number there."""
    order = list(order)
    return cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_place", 33))


def ranked(df: DataFrame, order: Sequence[Column | str], out: str = "rank") -> DataFrame:
    """df with every row's number from 0 in the order, and ``out``_total, the number of rows."""
    rows = _dealt(df, order)
    sizes = sorted((r[0], r[1]) for r in rows.groupBy("_part").count().collect())  # a row a range
    before = [0, *accumulate(n for _, n in sizes)]
    starts = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "_part long, _start long")
    ranks = rows.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.col("_place").bitwiseAND(F.lit(_PLACE)))
    return ranks.withColumn(f"{out}_total", F.lit(before[-1]).cast("long")).drop("_part", "_place", "_start")


def running(df: DataFrame, order: str, sums: Sequence[str]) -> DataFrame:
    """df with, for each column of sums, its running sum (``<c>_run``) and total (``<c>_all``), and ``next``: the order's value in the row after."""
    rows = _dealt(df, [order])
    kind = df.schema[order].dataType
    found = sorted(rows.groupBy("_part").agg(F.min_by(order, "_place").alias("first"), *(F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in sums)).collect(), key=lambda r: r["_part"])  # a row a range
    total = [sum(r[c] for r in found) for c in sums]
    at, table = [0.0] * len(sums), []
    for k, r in enumerate(found):
        table.append((r["_part"], found[k + 1]["first"] if k + 1 < len(found) else None, *at))
        at = [a + r[c] for a, c in zip(at, sums, strict=True)]
    schema = T.StructType([T.StructField("_part", T.LongType()), T.StructField("_after", kind), *(T.StructField(f"_{c}", T.DoubleType()) for c in sums)])
    w = Window.partitionBy("_part").orderBy("_place")
    rows = rows.join(F.broadcast(df.sparkSession.createDataFrame(table, schema)), "_part")
    runs = {f"{c}_run": F.col(f"_{c}") + F.coalesce(F.sum(F.col(c).cast("double")).over(w), F.lit(0.0)) for c in sums}
    runs |= {f"{c}_all": F.lit(t) for c, t in zip(sums, total, strict=True)}
    last = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("_place").desc())) == 1
    return rows.withColumns({**runs, "next": F.when(last, F.col("_after")).otherwise(F.lead(order).over(w))}).drop("_part", "_place", "_after", *(f"_{c}" for c in sums))


def quantiles(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, n, a column a share): exact quantiles of each group's known values, between two of them by how near the place is.

    Meant for few groups of any size: values are counted, the counts dealt to ranges
    of (by, value) and added up along them, and a row is kept only where a place
    falls, so no group is gathered. Groups without a known value give no row.
    """
    counted = df.where(F.col(by).isNotNull() & F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_c"))
    order = [by, value]
    rows = cut(counted.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    # A row a range and group: what comes before the range in the group.
    w = Window.partitionBy(by).orderBy("_part")
    whole = Window.partitionBy(by)
    parts = rows.groupBy(by, "_part").agg(F.sum("_c").alias("_s")).withColumns({"_before": F.sum("_s").over(w) - F.col("_s"), "n": F.sum("_s").over(whole)}).drop("_s")
    run = Window.partitionBy(by, "_part").orderBy(value)
    rows = rows.join(F.broadcast(parts), [by, "_part"]).withColumn("_last", F.col("_before") + F.sum("_c").over(run) - 1)
    place = {c: F.lit(p) * (F.col("n") - 1) for c, p in shares.items()}
    at = lambda k: F.max(F.when((F.col("_last") - F.col("_c") < k) & (k <= F.col("_last")), F.col(value)))
    ends = rows.groupBy(by, "n").agg(*(at(f(x).cast("long")).alias(f"_{name}_{c}") for c, x in place.items() for name, f in (("low", F.floor), ("high", F.ceil))))
    between = lambda c, x: F.when(F.col(f"_low_{c}") == F.col(f"_high_{c}"), F.col(f"_low_{c}")).otherwise((F.ceil(x) - x) * F.col(f"_low_{c}") + (x - F.floor(x)) * F.col(f"_high_{c}"))
    return ends.select(by, "n", *(between(c, x).alias(c) for c, x in place.items()))
