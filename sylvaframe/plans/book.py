"""How queries are written down: a function of (session, folder) and its SQL, under one key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import testbed


class Book:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, key: str, sql: str | None = None, uses: str = "") -> Callable:
        """``uses`` names the canonical tables that the SQL begins with."""

        def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
            self.queries[key] = f
            if sql is not None:
                text = sql.strip()
                head = ", ".join(testbed.SQL[u] for u in uses.split())
                self.sql[key] = f"WITH {head}, {text[5:]}" if head and text.startswith("WITH ") else f"WITH {head} {text}" if head else text
            return f

        return keep


def r(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """The columns rounded, as sums of floats depend on their order: by way of a decimal number of three digits more, so that a mean
    that ends exactly between two numbers is rounded up whatever the order of its sum was. The SQL twins say the same."""
    return df.withColumns({c: F.round(F.col(c).cast(f"decimal(38, {digits + 3})"), digits).cast("double") for c in columns})


def r_all(df: DataFrame, digits: int = 6) -> DataFrame:
    return r(df, *[c for c, t in df.dtypes if t == "double"], digits=digits)
