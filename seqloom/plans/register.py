"""Registers queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decimals of doubles that are compared.
DIGITS = 5


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracle[f.__name__] = sql
            return f

        return add


def rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    """Doubles to a fixed number of decimals, without negative zeros: sums depend on their order."""
    return df.withColumns({c: near(F.col(c), digits) for c in columns})


def near(c: Column, digits: int = DIGITS) -> Column:
    return F.round(c, digits) + F.lit(0.0)


def sql_near(expression: str, digits: int = DIGITS) -> str:
    return f"(round({expression}, {digits}) + 0.0)"
