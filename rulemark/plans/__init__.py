"""The query catalogue: every query with its DuckDB twin where SQL can express it."""

from rulemark.plans import registry

__all__ = ["registry"]
