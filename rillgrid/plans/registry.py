"""The registered queries by name, the SQL that gives the same rows, and how both round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
TIE = 0.5001  # of a unit of the ninth digit: exact halves go up in both engines, whatever the order that they add in


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; sql may write round(x, 9) for what r9 does."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = nines(sql)
        return f

    return add


def nines(sql: str) -> str:
    """sql with each round(x, 9) written as r9 computes it."""
    at = 0
    while (at := sql.find("round(", at)) >= 0:
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[at + 6 : end - 1]
        if inner.endswith(", 9"):
            sql = f"{sql[:at]}(floor(({inner[:-3]}) * 1e9 + {TIE}) / 1e9){sql[end:]}"
            at += 1
        else:
            at += 6
    return sql


def r9(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles rounded to 9 digits (and never -0.0), as both engines add in orders of their own."""
    names = columns or [c for c, k in df.dtypes if k == "double"]
    return df.withColumns({c: F.when(F.isnan(c), F.col(c)).otherwise(F.floor(F.col(c) * 1e9 + TIE) / 1e9) for c in names})
