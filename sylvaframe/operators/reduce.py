"""Time reductions: one function, in which the kind only chooses the bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions.stats import summary
from ..schema import Kind
from .order import exact_quantiles
from .slices import season_filter


def bucket(kind: Kind, ts: Column) -> Column:
    """Series kinds give a timestamp, averaging kinds a number (month-day: text)."""
    return {
        Kind.THIRTY_MIN_SERIES: lambda: ts,
        Kind.HOURLY_SERIES: lambda: C.truncated(ts, "hour"),
        Kind.DAILY_SERIES: lambda: C.truncated(ts, "day"),
        Kind.WEEKLY_SERIES: lambda: C.week_ending(ts),
        Kind.MONTHLY_SERIES: lambda: C.truncated(ts, "month"),
        Kind.YEARLY_SERIES: lambda: C.truncated(ts, "year"),
        Kind.THIRTY_MIN_AVG: lambda: (F.floor((F.hour(ts) * 60 + F.minute(ts)) / 30) * 30).cast("int"),
        Kind.HOURLY_AVG: lambda: F.hour(ts),
        Kind.DAILY_AVG: lambda: F.dayofyear(ts),
        Kind.WEEKLY_AVG: lambda: C.week_index(F.to_date(ts)),
        Kind.MONTHLY_AVG: lambda: F.month(ts),
        Kind.MONTH_DAY_AVG: lambda: F.month(ts) * 100 + F.dayofmonth(ts),
    }[kind]()


def reduce_time(df: DataFrame, kind: Kind, keys: list[str], q_low: float = 0.25, q_up: float = 0.75, std: bool = True, ts: str = "ts", value: str = "value", approx: bool = False) -> DataFrame:
    """keys, bucket, mean, std, median, qlow, qup, the quantiles from sketches if ``approx``. The half-hourly series is the identity: its value is its mean."""
    at = bucket(kind, F.col(ts)).alias("bucket")
    if kind is Kind.THIRTY_MIN_SERIES:
        return df.select(*keys, at, F.col(value).alias("mean"))
    return df.groupBy(*keys, at).agg(*summary(value, q_low, q_up, std, approx))


def dummy_date(kind: Kind, at: Column) -> Column:
    """The date in the year 2001 that stands for an averaging bucket."""
    start = F.lit("2001-01-01").cast("timestamp_ntz")
    if kind is Kind.THIRTY_MIN_AVG:
        return C.plus_seconds(start, at * 60)
    if kind is Kind.HOURLY_AVG:
        return C.plus_seconds(start, at * 3600)
    if kind is Kind.DAILY_AVG:
        return F.date_add(F.lit("2001-01-01").cast("date"), at - 1).cast("timestamp_ntz")
    if kind is Kind.MONTHLY_AVG:
        return F.add_months(F.lit("2001-01-01").cast("date"), at - 1).cast("timestamp_ntz")
    raise ValueError(kind)


def day_quantiles(df: DataFrame, q: list[float], keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Quantiles of each half-hour slot of the day, over all runs and days."""
    out = exact_quantiles(df, q, [*keys, bucket(Kind.THIRTY_MIN_AVG, F.col(ts)).alias("bucket")], value)
    return out.select(*keys, "bucket", *[F.col("_q")[k].alias(f"q{round(x * 100)}") for k, x in enumerate(q)])


def seasonal_yearly(df: DataFrame, months: list[int], keys: list[str], columns: list[str], hours: list[int] | None = None, ts: str = "ts") -> DataFrame:
    """Yearly means, over a season, of columns that are already summaries."""
    return season_filter(df, months, hours, ts).groupBy(*keys, F.year(ts).alias("year")).agg(*[F.avg(c).alias(c) for c in columns])


def window_means(df: DataFrame, first: int, last: int, step: int, length: int, month: int, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Means of one month inside the windows [y-01-01, (y + length)-12-31), y = first, first + step, ..., last. A boundary
    year lies in two windows. The windows of a row are computed, not joined."""
    y = F.year(ts)
    before_last_day = ~((F.month(ts) == 12) & (F.dayofmonth(ts) == 31))
    starts = F.filter(F.sequence(F.lit(first), F.lit(last), F.lit(step)), lambda s: (s <= y) & ((y < s + length) | ((y == s + length) & before_last_day)))
    return df.filter(F.month(ts) == month).withColumn("window", F.explode(starts)).groupBy(*keys, "window").agg(F.avg(value).alias("mean"))


def last_rows(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", tie: str | None = None) -> DataFrame:
    """The value at the last stamp for each key; ties are broken by the largest value (or ``tie``)."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(ts, tie or value)).alias("value"), F.max(ts).alias("ts"))


def masked_mean(df: DataFrame, mask: Column, keys: list[str], value: str = "value") -> DataFrame:
    """The mean where the mask holds; NaN and NULL are skipped, and a key without any value gives NULL."""
    return df.groupBy(*keys).agg(F.avg(F.when(mask & ~F.isnan(value), F.col(value))).alias("mean"))


def year_difference(df: DataFrame, first: int, second: int, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    mean = lambda y: F.avg(F.when(F.year(ts) == y, F.col(value)))
    return df.groupBy(*keys).agg((mean(second) - mean(first)).alias("difference"))


def period_total(df: DataFrame, months: list[int], keys: list[str], chosen: list[int], ts: str = "ts", value: str = "value") -> DataFrame:
    """Sums of daily means over a season, by year, and whether the year is a chosen one."""
    days = season_filter(df, months, ts=ts).groupBy(*keys, C.truncated(F.col(ts), "day").alias("day")).agg(F.avg(value).alias("v"))
    return days.groupBy(*keys, F.year("day").alias("year")).agg(F.sum("v").alias("total")).withColumn("chosen", F.col("year").isin(*chosen))


def subset_means(df: DataFrame, ts: str = "ts", value: str = "value") -> DataFrame:
    """Means by year, by day of year and by decimal hour, in one pass: (part, key, mean)."""
    parts = df.select(F.year(ts).cast("double").alias("year"), F.dayofyear(ts).cast("double").alias("doy"), C.decimal_hour(F.col(ts)).alias("hour"), F.col(value).alias("v"))
    sets = parts.groupingSets([["year"], ["doy"], ["hour"]], "year", "doy", "hour").agg(F.avg("v").alias("mean"), F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 3, "year").when(F.col("g") == 5, "doy").otherwise("hour")
    return sets.select(name.alias("part"), F.coalesce("year", "doy", "hour").alias("key"), "mean")


def replicate_mean(df: DataFrame, columns: list[str], keys: list, factor: float = -0.1) -> DataFrame:
    """Row means of replicate columns that skip NULL, averaged over the keys and scaled."""
    present = F.filter(F.array(*columns), lambda x: x.isNotNull() & ~F.isnan(x))
    mean = F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present))
    return df.withColumn("_m", mean).groupBy(*keys).agg((F.avg("_m") * factor).alias("mean"))


def group_quantiles(df: DataFrame, q: list[float], keys: list, value: str = "value", prefix: str = "J") -> DataFrame:
    """Several quantiles of each key, a column each."""
    out = exact_quantiles(df, q, keys, value)
    return out.select(*[c for c in out.columns if c not in ("mean", "_q")], *[F.col("_q")[k].alias(f"{prefix}{x:g}".replace(".", "_")) for k, x in enumerate(q)])


def resample_30min(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Means of 30-minute bins, named by their start; empty bins do not exist."""
    return df.groupBy(*keys, C.half_hour_bin(F.col(ts)).alias("bin")).agg(F.avg(value).alias("value"))


def coarser_band(df: DataFrame, unit: str, columns: list[str], keys: list[str], ts: str = "ts") -> DataFrame:
    """Daily or hourly means of a band (mean, qlow, qup) that is already there."""
    return df.groupBy(*keys, C.truncated(F.col(ts), unit).alias("bucket")).agg(*[F.avg(c).alias(c) for c in columns])


def long_history_yearly(df: DataFrame, start_year: int, offset: str = "offset", value: str = "value") -> DataFrame:
    """Yearly means of seconds on the 365-day calendar, for years of any size."""
    year = (F.lit(start_year) + F.floor(F.col(offset) / C.YEAR_365)).cast("int")
    return df.groupBy(year.alias("year")).agg(F.avg(value).alias("mean"))
