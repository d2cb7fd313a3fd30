"""Queries by name, and DuckDB SQL that gives the same rows where SQL can.

Doubles are rounded to six places on both sides, because sums are taken in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded; minus zero becomes zero."""
    return df.withColumns({f.name: F.round(f.name, digits) + 0.0 for f in df.schema.fields if f.dataType.typeName() in ("double", "float")})


def query(name: str, sql: str | None = None, ctes: str = "", doubles: str = "") -> Callable[[Query], Query]:
    """Registers a query. ``sql`` selects from ``ctes``; ``doubles`` are its columns to round."""

    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            replace = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in doubles.split())
            head = f"WITH {ctes} " if ctes else ""
            ORACLE[name] = f"{head}SELECT * REPLACE ({replace}) FROM ({sql}) AS answer" if replace else head + sql
        return f

    return add
