"""Registration of checked queries: a Spark callable and, where SQL can say it, the oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hazardflow.functions.times import round_half_up

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(value: Column | str) -> Column:
    """Six decimals, rounded the same way in both engines."""
    return round_half_up(F.col(value) if isinstance(value, str) else value, 6)


def sql_round(expression: str, digits: int = 6) -> str:
    scale = 10**digits
    return f"floor(({expression}) * {scale} + 0.5) / {scale}"


def stamp(ts: Column | str) -> Column:
    """A time as text, so that engines need not agree on a time type."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def sql_stamp(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"
