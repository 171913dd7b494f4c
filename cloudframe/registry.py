"""Registry of runnable queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Both engines round the same way: a floor whose tie lies where no short decimal ends, so that the last bits of a
# floating-point sum cannot move a value across it.
_TIE = 0.4876543


def query(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is the SQL that must give the same rows."""
    def register(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function
    return register


def q(column: Column | str, digits: int = 6) -> Column:
    """Round for comparison (Spark side)."""
    column = F.col(column) if isinstance(column, str) else column
    scale = 10.0 ** digits
    return F.floor(column * scale + _TIE) / scale


def Q(expression: str, digits: int = 6) -> str:
    """Round for comparison (SQL side)."""
    scale = 10 ** digits
    return f"(floor(({expression}) * {scale}.0::DOUBLE + {_TIE}::DOUBLE) / {scale}.0::DOUBLE)"
