"""Registry of the queries over the tables and of the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Adds a query under its name, with the SQL for the same rows where there is one."""

    def add(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = query
        if sql is not None:
            _ORACLES[name] = sql
        return query

    return add


def queries() -> dict[str, Query]:
    import folia.plans  # noqa: F401  registers them

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    import folia.plans  # noqa: F401  registers them

    return dict(_ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval with fusion and recency boost."""
    return queries()["ret5_recency_boost"](spark, sf_dir)
