"""Where queries are registered with their SQL, and what the modules that register them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def r9(c: Column | str) -> Column:
    """Nine digits, half up as ``round`` has it, which takes a decimal text of each value; a column's values that lie clear of halves are rounded as whole numbers, with the same result."""
    if not isinstance(c, str):
        return F.round(c, 9)
    value = F.col(c)
    whole = F.rint(value * 1e9)
    clear = (F.abs(value) < 1000.0) & (F.abs(value * 1e9 - whole) < 0.499)
    return F.when(clear, whole / 1e9 + 0.0).otherwise(F.round(value, 9))
