"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL twin if there is one."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def r6(expression: str) -> str:
    """The SQL form of six-digit half-up rounding."""
    return f"floor(({expression}) * 1e6 + 0.5) / 1e6"


def load_all() -> None:
    from traceweave.catalog import (  # noqa: F401
        datasets,
        evaluation,
        identity,
        learning,
        live,
        rounds,
        scalars,
        telemetry,
        traces,
    )
