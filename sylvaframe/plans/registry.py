"""Every registered query of the library and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ensemble_queries, forcing_queries, score_queries, source_queries, time_queries

BOOKS = [time_queries.book, ensemble_queries.book, score_queries.book, forcing_queries.book, source_queries.book]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for b in BOOKS for k, f in b.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for b in BOOKS for k, q in b.sql.items()}
