"""The list of registered queries, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFunction = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: QueryFunction
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[QueryFunction], QueryFunction]:
    """Register a function under its own name."""

    def add(fn: QueryFunction) -> QueryFunction:
        REGISTRY[fn.__name__] = Query(fn, sql)
        return fn

    return add


def r6(column: str | Column, name: str | None = None) -> Column:
    """Six decimals, so that sums taken in another order compare equal."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, 6).alias(name or column)


def spread(column: str, prefix: str, n: int = 5) -> list[Column]:
    """Array elements as columns ``prefix0``..."""
    return [F.round(F.get(column, F.lit(i)), 6).alias(f"{prefix}{i}") for i in range(n)]
