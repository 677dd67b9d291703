"""Approximate quantiles by sketches that are kept as a column and merged: a sketch of each run and bucket, written once, serves any set of runs and any
coarser bucket without reading the values again. A group of any size takes a few kilobytes, in the aggregation and in the table.

The sketches are Spark's KLL sketches of doubles. With ``K`` = 400 the rank of a quantile is off by at most about 0.7 % of the rows (99 % of the time), whatever is
merged; the quantile is one of the values. NULL and NaN are left out; a group without values has NULL quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch, and the error of ranks to be expected of it.
K, RANK_ERROR = 400, 0.007


def quantile(value: Column, q: float, k: int = K) -> Column:
    """An aggregate: the approximate quantile of a column."""
    return F.when(F.count(value) > 0, F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(value.cast("double"), k), F.lit(float(q))))


def sketched(df: DataFrame, keys: Sequence[Column | str], value: str = "value", k: int = K) -> DataFrame:
    """(keys, n, total, sketch) of each group."""
    v = F.when(~F.isnan(value), F.col(value).cast("double"))
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.kll_sketch_agg_double(v, k).alias("sketch"))


def merged(sketches: DataFrame, keys: Sequence[Column | str], k: int = K) -> DataFrame:
    """(keys, n, total, sketch) of coarser groups, from what ``sketched`` or ``merged`` has made."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def quantiles(sketches: DataFrame, q: Sequence[float]) -> DataFrame:
    """The keys, n, mean and a column for each quantile, as ``q20``."""
    keys = [c for c in sketches.columns if c not in ("n", "total", "sketch")]
    at = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(x)))).alias(f"q{round(x * 100)}") for x in q]
    return sketches.select(*keys, "n", F.try_divide("total", "n").alias("mean"), *at)
