"""Sinks: sorted CSV, append-only JSON lines, wide pivots, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sorted_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """CSV in one global order, nulls last and written as nothing; a part file a range, none gathered in one task."""
    df.orderBy(*(F.col(c).asc_nulls_last() for c in order)).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def append_json(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines; a commit is whole files, so no line is ever torn."""
    df.write.mode("append").json(path)


def wide(df: DataFrame, row: str, column: str, value: str, names: list | None = None) -> DataFrame:
    """A column a name; give ``names`` to spare the pass that collects them."""
    return df.groupBy(row).pivot(column, names).agg(F.min(value))


def xml(df: DataFrame, path: str, row: str = "invstOrSec", root: str = "invstOrSecs") -> None:
    df.write.mode("overwrite").format("xml").option("rootTag", root).option("rowTag", row).save(path)


def report(df: DataFrame) -> DataFrame:
    """One markdown table row a row: text ready to be written."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
