"""Named queries over the given tables, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name; ``sql`` is the DuckDB statement with the same columns."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def load_all() -> None:
    import importlib

    for name in ("ranked", "selected", "matching", "clips", "catalog", "folder_views", "streams", "upkeep"):
        importlib.import_module(f"{__name__}.{name}")
