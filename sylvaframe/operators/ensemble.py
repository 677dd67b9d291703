"""Operators over the runs of an ensemble; the long table makes the loop over runs a grouping key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sketch import quantile
from ..functions.stats import summary
from ..schema import Kind
from .order import exact_quantiles
from .reduce import bucket, reduce_time
from .slices import select_layer, slice_dates


def multi_slice(df: DataFrame, begin: str, end: str, kind: Kind, q_low: float = 0.25, q_up: float = 0.75) -> DataFrame:
    return reduce_time(slice_dates(df, begin, end), kind, ["fid", "variable"], q_low, q_up)


def multi_slice_layered(df: DataFrame, layer: int, keys: list[Column | str], values: str = "values") -> DataFrame:
    return select_layer(df, layer, values).groupBy("fid", *keys).agg(*summary())


def multi_slice_avg(df: DataFrame, kind: Kind, keys: list[str], q_low: float = 0.25, q_up: float = 0.75, approx: bool = False) -> DataFrame:
    """Means of each run's bucket first, then mean, median and quantiles of these over the runs. ``approx`` here and below: quantiles by sketches (``sketch``)."""
    runs = df.groupBy("fid", *keys, bucket(kind, F.col("ts")).alias("bucket")).agg(F.avg("value").alias("value"))
    return runs.groupBy(*keys, "bucket").agg(*summary("value", q_low, q_up, std=False, approx=approx))


def ensemble_band(df: DataFrame, keys: list[str], q_low: float = 0.2, q_up: float = 0.8, factor: float = 1.0, raw: bool = False, approx: bool = False) -> DataFrame:
    """mean, qlow, qup over the runs at each key (an outer join on time, as runs that lack it have no row). NaN is
    skipped; a negative factor swaps the quantiles. ``raw`` keeps the values, sorted."""
    v = F.when(~F.isnan("value"), F.col("value") * factor)
    q = quantile if approx else F.percentile
    out = [F.avg(v).alias("mean"), q(v, q_low).alias("qlow"), q(v, q_up).alias("qup"), F.count(v).alias("n")]
    return df.groupBy(*keys).agg(*out, *([F.sort_array(F.collect_list(v)).alias("raw")] if raw else []))


def ensemble_quantiles(df: DataFrame, at: Column, kind: Kind, keys: list[str], approx: bool = False) -> DataFrame:
    """Median and the 0.1 and 0.9 quantiles over the runs at each time, then their means by a kind of bucket."""
    q = quantile if approx else F.percentile
    each = df.groupBy(*keys, at.alias("ts")).agg(*[q(F.col("value"), x).alias(name) for x, name in ((0.5, "median"), (0.1, "q10"), (0.9, "q90"))])
    return each.groupBy(*keys, bucket(kind, F.col("ts")).alias("bucket")).agg(*[F.avg(c).alias(c) for c in ("median", "q10", "q90")])


def split_baseline(df: DataFrame, baseline: int = 0) -> DataFrame:
    return df.withColumn("role", F.when(F.col("fid") == baseline, "baseline").otherwise("ensemble"))


def values_at(df: DataFrame, targets: DataFrame, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(rows at the target instants, targets that no row has). Spark broadcasts the targets if it finds them small."""
    return df.join(targets.select(ts).distinct(), ts, "left_semi"), targets.join(df.select(ts).distinct(), ts, "left_anti")


def normalize_by_max(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """value / the key's maximum: an aggregation and a join, so that a large key is never one window."""
    top = df.groupBy(*keys).agg(F.max(value).alias("_max"))
    return df.join(top, keys).withColumn("normalized", F.try_divide(value, "_max")).drop("_max")


def scenario_stack(df: DataFrame, order: dict[str, list[str]]) -> DataFrame:
    """Labelled rows (see ``store.read_scenarios``) of the scenarios whose labels are listed, with their place in the fixed order: the first label's list
    outermost, as nested loops over the lists would go. A column, not a chain of unions."""
    place = F.lit(0)
    for label, names in order.items():
        df = df.filter(F.col(label).isin(*names))
        place = place * len(names) + F.array_position(F.array(*map(F.lit, names)), F.col(label)) - 1
    return df.withColumn("stack_order", place.cast("int"))


def compare_ensembles(old: DataFrame, new: DataFrame, kind: Kind) -> DataFrame:
    both = old.withColumn("ensemble", F.lit("old")).unionByName(new.withColumn("ensemble", F.lit("new")))
    out = exact_quantiles(both, [0.5], ["ensemble", bucket(kind, F.col("ts")).alias("bucket")])
    return out.select("ensemble", "bucket", "mean", F.col("_q")[0].alias("median"))


def change_split(df: DataFrame, year: int, keys: list, ts: str = "ts") -> DataFrame:
    """Means before and from a year of change on."""
    return df.withColumn("period", F.when(F.year(ts) < year, "baseline").otherwise("changed")).groupBy("period", *keys).agg(F.avg("value").alias("mean"))


def progress(df: DataFrame, key: str = "job", ts: str = "ts", tie: str = "task", duration: str = "duration_s") -> DataFrame:
    """For each finished task: its rank, the total, and seconds since the earliest start, of its job."""
    w = W.partitionBy(key)
    begin = F.unix_seconds(F.col(ts).cast("timestamp")) - F.col(duration)
    rank = F.row_number().over(w.orderBy(ts, tie))
    return df.select(key, tie, rank.alias("rank"), F.count(F.lit(1)).over(w).alias("total"), (F.unix_seconds(F.col(ts).cast("timestamp")) - F.min(begin).over(w)).alias("elapsed_s"))
