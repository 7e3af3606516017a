"""All registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import adapter

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, and its DuckDB SQL over the adapter's views."""

    def register(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _sql[name] = adapter.sql(sql, "duckdb")
        return f

    return register


def _load() -> None:
    from tidemark.plans import analytics, constraints, counters, extraction, schema, store, trust  # noqa: F401


def queries() -> dict[str, Query]:
    """Every query of the inventory: id -> callable(spark, sf_dir)."""
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL per query id."""
    _load()
    return dict(_sql)
