"""Registry of named queries and their DuckDB oracle SQL.

Each query is a function ``(spark, sf_dir) -> DataFrame`` over the driver
tables; ``oracle`` is the same computation as DuckDB SQL over the same
tables, or ``None`` for an ordered fold that SQL cannot express (those are
tested against a plain Python model instead).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
BENCH: list[str] = []


def register(name: str, oracle: str | None = None, bench: bool = False):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        if bench:
            BENCH.append(name)
        return fn
    return deco


def load_all() -> None:
    """Import every catalog module so its ``register`` calls run."""
    from . import catalog_rollups, catalog_billing, catalog_sequence, catalog_validation, catalog_metrics, catalog_folds, catalog_streaming, catalog_stored  # noqa: F401
