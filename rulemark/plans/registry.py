"""All registered queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "rank_one_fund"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; ``sql`` is its DuckDB twin."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


from rulemark.plans import chains, events, extremes, filings, history, identity, lattice, more, noise, portfolio, regions, repair, reports, rules, spec, text  # noqa: E402, F401  registers their queries
