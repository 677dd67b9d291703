"""Enumerations and the canonical tables: long tables with a row for each value."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL_LONG = "fid INT, sim_type STRING, time_res STRING, cat STRING, variable STRING, layer INT, ts TIMESTAMP_NTZ, value DOUBLE"
OBS_LONG = "source STRING, variable STRING, ts TIMESTAMP_NTZ, value DOUBLE"
SCORES = "fid INT, metric STRING, era STRING, value DOUBLE"

#: Names in output file names.
SIM_TYPES = ("static", "transient", "spinup", "fluxnetdata")
TIME_RES = ("timestep", "daily", "weekly", "monthly", "yearly")


class Kind(Enum):
    """How a time reduction buckets: *_series keep the calendar, *_avg fold it."""

    THIRTY_MIN_SERIES = "thirty_min_series"
    HOURLY_SERIES = "hourly_series"
    DAILY_SERIES = "daily_series"
    WEEKLY_SERIES = "weekly_series"
    MONTHLY_SERIES = "monthly_series"
    YEARLY_SERIES = "yearly_series"
    THIRTY_MIN_AVG = "thirty_min_avg"
    HOURLY_AVG = "hourly_avg"
    DAILY_AVG = "daily_avg"
    WEEKLY_AVG = "weekly_avg"
    MONTHLY_AVG = "monthly_avg"
    MONTH_DAY_AVG = "month_day_avg"


def null_nan(value: Column) -> Column:
    """NaN as NULL, so that aggregates skip it."""
    return F.when(F.isnan(value), None).otherwise(value)


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: null_nan(F.col(c)) for c, t in df.dtypes if t in ("double", "float")})
