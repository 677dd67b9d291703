"""Filters and projections of long tables."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slice_dates(df: DataFrame, begin: str, end: str, closed: bool = False, ts: str = "ts") -> DataFrame:
    """Rows in [begin, end), or [begin, end] if closed; plain comparisons, which reach the Parquet scan."""
    t, stop = F.col(ts), F.lit(end).cast("timestamp_ntz")
    return df.filter((t >= F.lit(begin).cast("timestamp_ntz")) & (t <= stop if closed else t < stop))


def slice_years(df: DataFrame, first: int, last: int, ts: str = "ts") -> DataFrame:
    """From 1 January of ``first`` up to 1 January of ``last``."""
    return slice_dates(df, f"{first}-01-01", f"{last}-01-01", ts=ts)


def slice_years_months(df: DataFrame, first: tuple[int, int], last: tuple[int, int], ts: str = "ts") -> DataFrame:
    return slice_dates(df, f"{first[0]}-{first[1]:02d}-01", f"{last[0]}-{last[1]:02d}-01", ts=ts)


def explode_layers(df: DataFrame, values: str = "values") -> DataFrame:
    """A row for each layer (from 0) of an array column."""
    return df.select(*[c for c in df.columns if c != values], F.posexplode(values).alias("layer", "value"))


def select_layer(df: DataFrame, layer: int, values: str = "values") -> DataFrame:
    """One layer as a plain series; the others are never exploded."""
    return df.select(*[c for c in df.columns if c != values], F.get(values, F.lit(layer)).cast("double").alias("value"))


def select_runs(df: DataFrame, ids: list[int], key: str = "fid") -> DataFrame:
    """The runs of an ensemble; an id that it does not have is an error, raised when the result is computed."""
    want = df.sparkSession.createDataFrame([(int(i),) for i in ids], f"{key} {dict(df.dtypes)[key]}")
    missing = want.join(df.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("n"), F.collect_list(key).alias("ids"))
    guard = missing.select(F.when(F.col("n") > 0, F.raise_error(F.concat(F.lit("unknown runs: "), F.col("ids").cast("string")))).cast("boolean").alias("_bad"))
    return df.join(F.broadcast(want), key, "left_semi").join(F.broadcast(guard), F.col("_bad").isNull()).drop("_bad")


def season_filter(df: DataFrame, months: list[int], hours: list[int] | None = None, ts: str = "ts") -> DataFrame:
    keep = F.month(ts).isin(*months)
    return df.filter(keep & F.hour(ts).isin(*hours) if hours else keep)


def in_windows(df: DataFrame, windows: list[tuple[str | None, str | None]], ts: str = "ts") -> DataFrame:
    """Rows in any of the half-open ranges; an open end is None."""
    t = F.col(ts)
    each = [functools.reduce(operator.and_, [*([t >= F.lit(a).cast("timestamp_ntz")] if a else []), *([t < F.lit(b).cast("timestamp_ntz")] if b else [])], F.lit(True)) for a, b in windows]
    return df.filter(functools.reduce(operator.or_, each))


def bounds(limits: dict[str, float | tuple[float | None, float | None]]) -> Column:
    """A conjunction: {column: upper bound} or {column: (low, high)}, both ends allowed."""
    parts = []
    for name, limit in limits.items():
        low, high = limit if isinstance(limit, tuple) else (None, limit)
        parts += [F.col(name) >= low] if low is not None else []
        parts += [F.col(name) <= high] if high is not None else []
    return functools.reduce(operator.and_, parts, F.lit(True))


def constrain(df: DataFrame, limits: dict) -> DataFrame:
    return df.filter(bounds(limits))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that have no value in any row (NULL or NaN); one aggregation finds them."""
    has = lambda c, t: F.count(F.when(c.isNotNull() & ~F.isnan(c), 1)) if t in ("double", "float") else F.count(c)
    found = df.agg(*[has(F.col(c), t).alias(c) for c, t in df.dtypes]).first()
    return df.select(*[c for c in df.columns if found[c]])


def clean_sensor(df: DataFrame, contains: str, until: str, low: float = -40.0, high: float = 0.0) -> DataFrame:
    """Readings (ts, id, psi in bar) of matching sensors, in range, before a date, in MPa."""
    return df.filter(F.col("id").contains(contains) & F.col("psi").between(low, high) & (F.col("ts") < F.lit(until).cast("timestamp_ntz"))).withColumn("psi", F.col("psi") * 0.1)


def clamp_low(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.greatest(F.col(c), F.lit(v)) for c, v in limits.items()})


@dataclass(frozen=True)
class Pair:
    """A compared quantity: signed model terms and signed observed terms, e.g. NEE = het_resp - npp."""

    name: str
    model: tuple[tuple[str, float], ...]
    obs: tuple[tuple[str, float], ...] = ()
    obs_factor: float = 1.0


def combine_terms(df: DataFrame, name: str, terms: tuple[tuple[str, float], ...], keys: list[str], value: str = "value") -> DataFrame:
    """The signed sum of variables that lie at the same keys; a key without all of the terms is left out."""
    sign = functools.reduce(lambda c, t: c.when(F.col("variable") == t[0], t[1]), terms, F.when(F.lit(False), 0.0))
    rows = df.filter(F.col("variable").isin(*[v for v, _ in terms]))
    sums = rows.groupBy(*keys).agg(F.sum(sign * F.col(value)).alias(value), F.count_distinct("variable").alias("_terms"))
    return sums.filter(F.col("_terms") == len(terms)).drop("_terms").withColumn("variable", F.lit(name))


def ramp_change(df: DataFrame, change: float, years: int, last_year: int, value: str = "value", floor: float | None = None) -> DataFrame:
    """Adds a linear ramp over the last years of a monthly series (year, month, value)."""
    since = (F.col("year") - (last_year - years + 1)) * 12 + F.col("month") - 1
    out = F.col(value) + F.when(F.col("year") > last_year - years, since / 12.0 / years * change).otherwise(0.0)
    return df.withColumn(value, F.greatest(out, F.lit(floor)) if floor is not None else out)


def snap_coordinate(x: Column, resolution: float, offset: float, low: float, high: float) -> Column:
    """The nearest grid coordinate (ties to even), kept inside the grid."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.bround((x - offset) / resolution) * resolution + offset))


def site_of_path(path: Column) -> Column:
    """``.../AA-Bbb_forcing.dat`` -> ``AA-Bbb``."""
    return F.regexp_extract(path, r"([A-Z]{2}-[A-Za-z0-9]{3})[^/]*$", 1)
