"""Registration of queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions.scalar import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows where there is some."""
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def shown(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """The columns, doubles rounded for output."""
    kinds = dict(df.dtypes)
    return df.select(*[rounded(F.col(c), digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns or df.columns])
