"""Data quality checks as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(rows: DataFrame, checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """(name, severity, passed, n_failed) of row conditions, all in one pass; a null condition fails."""
    bad = rows.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(f"c{k}") for k, (_, c) in enumerate(checks.values())))
    each = [F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"), (F.col(f"c{k}") == 0).alias("passed"), F.col(f"c{k}").alias("n_failed")) for k, (n, (s, _)) in enumerate(checks.items())]
    return bad.select(F.inline(F.array(*each)))


def unique(rows: DataFrame, keys: list[str], name: str, severity: str = "error") -> DataFrame:
    """The check that no key occurs twice."""
    n = rows.groupBy(*keys).count().agg(F.count_if(F.col("count") > 1).alias("n"))
    return n.select(F.lit(name).alias("name"), F.lit(severity).alias("severity"), (F.col("n") == 0).alias("passed"), F.col("n").alias("n_failed"))


def band(difference: Column) -> Column:
    return F.when(difference.isNull(), "missing").when(difference <= 0.01, "within 1%").when(difference <= 0.10, "1-10%").otherwise("over 10%")
