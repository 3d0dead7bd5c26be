"""Every registered query with a DuckDB twin gives that twin's rows on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import rulemark.plans.registry as registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return c


def norm(v):
    return "~" if v is None else repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_twin(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    twin = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(twin.columns) == columns
    assert got == sorted(tuple(norm(v) for _, v in sorted(zip(twin.columns, row, strict=True))) for row in twin.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_flagship_is_registered():
    assert registry.FLAGSHIP in registry.QUERIES and registry.FLAGSHIP in registry.ORACLE_SQL


def test_wide_price_pivot_holds_every_price(spark):
    """As many prices as the parent index has, whatever their assets and quarters."""
    from pyspark.sql import functions as F

    from rulemark.plans import registry

    where = "/root/testdata/sf0.001"
    wide = registry.QUERIES["wide_price_pivot"](spark, where)
    assert wide.select(F.explode(F.array("q1", "q2", "q3", "q4")).alias("p")).where("p IS NOT NULL").count() == registry.QUERIES["implied_price_panel"](spark, where).count()
