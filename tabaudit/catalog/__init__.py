"""Runnable queries over the driver tables and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL if it has one."""

    def register(function: Query) -> Query:
        QUERIES[name or function.__name__] = function
        if sql is not None:
            ORACLES[name or function.__name__] = sql.strip()
        return function

    return register


def load_all() -> None:
    """Import the modules that register queries."""
    from tabaudit.catalog import audit, cleaning, evaluation, modelling, reporting, tables  # noqa: F401
