"""Joins that have no syntax of their own: as-of, range, nearest, tiered, supersede."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a lookup table that may be broadcast; above it the join shuffles by bucket.
SMALL = 10_000


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], tolerance: Column | None = None, tie: str | None = None) -> DataFrame:
    """Left rows with the values of the latest right row at or before their time.

    Both sides are put in one order per key and the last seen right row is carried
    forward, so each side is shuffled once and no pairs are made. ``tolerance``:
    the longest age (a day count or interval difference as a double in seconds);
    older rows give nulls. ``tie``: a right column; of equal times its greatest wins.
    """
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    one = left.select(*left.columns, seconds(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("string").alias("_tie"), F.lit(None).cast(_struct(right, [right_time, *values])).alias("_r"))
    two = right.where(F.col(right_time).isNotNull()).select(
        *(F.col(c) if c in by else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns),
        seconds(right_time).alias("_t"), F.lit(0).alias("_side"), (F.lpad(F.col(tie).cast("string"), 20, "0") if tie else F.lit(None).cast("string")).alias("_tie"),
        F.struct(right_time, *values).alias("_r"),
    )
    order = Window.partitionBy(*by).orderBy(F.col("_t").asc_nulls_first(), "_side", F.col("_tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    out = one.unionByName(two).withColumn("_got", F.last("_r", ignorenulls=True).over(order)).where("_side = 1")
    age = F.col("_t") - F.unix_micros(F.col(f"_got.{right_time}").cast("timestamp")) / 1e6
    good = F.col("_t").isNotNull() if tolerance is None else F.col("_t").isNotNull() & (age <= tolerance)
    got = F.when(good, F.col("_got"))
    return out.select(*left.columns, *(got[c].alias(c if c not in left.columns else f"right_{c}") for c in [right_time, *values]))


def _struct(df: DataFrame, columns: list[str]):
    return df.select(F.struct(*columns).alias("s")).schema["s"].dataType


def in_ranges(rows: DataFrame, value: str, ranges: list[tuple[str, float, float]], out: str) -> DataFrame:
    """rows with the first listed range (name, low, high) that holds ``value``; null if none does."""
    hit = F.coalesce(*(F.when(F.col(value).between(low, high), F.lit(name)) for name, low, high in ranges))
    return rows.withColumn(out, hit)


def latest(rows: DataFrame, by: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order, as amendments replace originals."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def tiered(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Matches by progressively looser forms.

    Both sides hold (id, tier, form). A form counts only if exactly one right id
    has it; a left id takes its lowest such tier, else it is ambiguous (several
    right ids at some tier) or unmatched.
    """
    pool = right.select("form", right_id).distinct().groupBy("form").agg(F.count("*").alias("n"), F.min(right_id).alias(right_id))
    seen = left.join(pool, "form", "left")
    best = F.min(F.when(F.col("n") == 1, F.struct("tier", right_id)))
    out = seen.groupBy(left_id).agg(best.alias("b"), F.max(F.coalesce("n", F.lit(0))).alias("most"))
    status = F.when(F.col("b").isNotNull(), "matched").when(F.col("most") > 1, "ambiguous").otherwise("unmatched")
    return out.select(left_id, F.col(f"b.{right_id}").alias(right_id), F.col("b.tier").alias("tier"), status.alias("status"))
