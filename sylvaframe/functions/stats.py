"""Aggregates of a value column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sketch import quantile


def summary(value: str | Column = "value", q_low: float = 0.25, q_up: float = 0.75, std: bool = True, approx: bool = False) -> list[Column]:
    """mean, std (sample; NULL for one row), median, qlow, qup; quantiles are exact and interpolated, or with ``approx`` those of a sketch, for groups whose values
    are too many to be held."""
    v = F.col(value) if isinstance(value, str) else value
    q = quantile if approx else F.percentile
    out = [F.avg(v).alias("mean"), q(v, 0.5).alias("median"), q(v, q_low).alias("qlow"), q(v, q_up).alias("qup")]
    return [out[0], F.stddev_samp(v).alias("std"), *out[1:]] if std else out


def rmse(model: Column, obs: Column) -> Column:
    return F.sqrt(F.avg((model - obs) * (model - obs)))


def rounded(df, digits: int = 6, skip: tuple = ()):
    """All doubles rounded, for reports."""
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double" and c not in skip})
