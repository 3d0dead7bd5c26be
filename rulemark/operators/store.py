"""Merging into stored tables, and where facts come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], frozen: list[str] | None = None) -> DataFrame:
    """old with new merged in by key: known new values win, but for ``frozen`` columns known old ones do."""
    columns = [c for c in old.columns if c not in keys]
    a, b = old.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    pick = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")) if c in (frozen or []) else F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}"))
    return a.join(b, on, "full").select(*(F.coalesce(F.col(f"b.{k}"), F.col(f"a.{k}")).alias(k) for k in keys), *(pick(c).alias(c) for c in columns))


def provenance(facts: DataFrame, chain: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """facts with the columns of each link of the chain; a missing link leaves nulls, never drops a fact."""
    for link, on in chain:
        facts = facts.join(link, on, "left")
    return facts


def unseen(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows not stored yet, one of each key: an idempotent append."""
    return incoming.dropDuplicates(keys).join(stored.select(*keys).distinct(), keys, "left_anti")
