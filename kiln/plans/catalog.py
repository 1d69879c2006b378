"""Registry of named queries: a Spark builder and, where SQL can express it,
the DuckDB oracle text over the same parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kiln.plans.views import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``sql`` is
    its DuckDB oracle (``views`` are inlined as CTEs)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = with_views(sql.strip(), *views)
        return fn
    return deco


def _load() -> None:
    # importing the modules registers their queries
    from kiln.plans import corpus, logs, metrics, runs, telemetry, experiments, sampling, sources  # noqa: F401


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
