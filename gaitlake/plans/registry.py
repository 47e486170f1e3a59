"""Named queries over the test tables, each with its DuckDB equivalent where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "velocity_std"

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Decorator: adds a query under ``name``, with its oracle."""

    def add(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = query
        if oracle:
            _ORACLES[name] = oracle
        return query

    return add


def queries() -> dict[str, Query]:
    from gaitlake.plans import pose_queries, table_queries  # noqa: F401  register on import

    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    queries()
    return dict(_ORACLES)
