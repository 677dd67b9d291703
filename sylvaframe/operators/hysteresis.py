"""Diurnal loops of two variables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import snap_half_hour
from .ensemble import ensemble_band
from .joins import overlap_or_full
from .order import exact_quantiles


def diurnal_obs(df: DataFrame, keys: list[str], q_low: float = 0.2, q_up: float = 0.8) -> DataFrame:
    """mean, qlow, qup by half-hour slot; a single value stands for all three."""
    slot = F.pmod(snap_half_hour(F.col("ts")), F.lit(24.0)).alias("slot")
    out = exact_quantiles(df, [q_low, q_up], [*keys, slot])
    return out.select(*keys, "slot", "mean", F.col("_q")[0].alias("qlow"), F.col("_q")[1].alias("qup"))


def diurnal_model(df: DataFrame, obs: DataFrame | None = None) -> DataFrame:
    """The band over runs at each time, at observed times only where there are any, then its mean by slot."""
    rows = overlap_or_full(df, obs, ["variable"]) if obs is not None else df
    band = ensemble_band(rows, ["variable", "ts"])
    slot = F.pmod(snap_half_hour(F.col("ts")), F.lit(24.0)).alias("slot")
    return band.groupBy("variable", slot).agg(*[F.avg(c).alias(c) for c in ("mean", "qlow", "qup")])


def hysteresis_loop(x: DataFrame, y: DataFrame) -> DataFrame:
    """Two diurnal tables (slot, mean, qlow, qup) joined by slot, suffixed, in order; the first point is repeated as the last."""
    side = lambda df, s: df.select("slot", *[F.col(c).alias(f"{c}_{s}") for c in ("mean", "qlow", "qup")])
    both = side(x, "x").join(side(y, "y"), "slot").withColumn("position", F.col("slot"))
    first = both.agg(F.min(F.struct("slot", *[c for c in both.columns if c not in ("slot", "position")])).alias("f")).filter("f IS NOT NULL").select("f.*")
    return both.unionByName(first.withColumn("position", F.lit(24.0)))


def loop_errors(loop: DataFrame) -> DataFrame:
    return loop.withColumns({f"{e}_{s}": F.col(a) - F.col(b) for s in "xy" for e, a, b in (("low", f"mean_{s}", f"qlow_{s}"), ("up", f"qup_{s}", f"mean_{s}"))})


def midday_point(loop: DataFrame, slot: float = 12.0) -> DataFrame:
    return loop.filter(F.col("position") == slot)
