"""Monthly to daily to half-hourly values, for all cells and years at once. Arrays of a month (28 to 31 values) or a day (48)
are rows' own values, so nothing is shuffled after the months are brought together. They are exploded by the outer form: for the
other one the optimizer adds a filter on the array's size, which computes the array twice."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import science as S

SLOTS = 48
#: Seconds of a slot, joules to megajoules, light per shortwave, solar constant (W m-2), transmission of a clear sky.
SLOT_SECONDS, TO_MJ, PAR_PER_SW, SOLAR, CLEAR = 1800.0, 1e-6, 0.5, 1362.0, 0.76


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def squeeze(days: Column, limit: Column, above: bool) -> Column:
    """Values beyond a limit are set to it; what that adds is taken from the others in proportion to their distance."""
    beyond = (lambda x: F.greatest(limit - x, F.lit(0.0))) if above else (lambda x: F.greatest(x - limit, F.lit(0.0)))
    room = (lambda x: F.greatest(x - limit, F.lit(0.0))) if above else (lambda x: F.greatest(limit - x, F.lit(0.0)))
    moved, free = total(F.transform(days, beyond)), total(F.transform(days, room))
    share = F.when(free > 0, F.try_divide(moved, free)).otherwise(0.0)
    if above:
        return F.transform(days, lambda x: F.when(x <= limit, limit).otherwise(F.greatest(limit, x - share * (x - limit))))
    return F.transform(days, lambda x: F.when(x >= limit, limit).otherwise(F.least(limit, x + share * (limit - x))))


def month_line(before: Column, this: Column, after: Column, days: Column) -> Column:
    """Daily values on two straight lines that meet in the middle of the month; the mean of the month is kept. The ends
    are the means with the neighbours; an odd month's middle day takes what the others leave."""
    begin, end = (before + this) / 2, (this + after) / 2
    middle = this - ((begin - this) + (end - this)) / 2
    half = days / 2.0
    line = F.transform(F.sequence(F.lit(0), days - 1), lambda i: F.when(i + 0.5 < half, begin + (middle - begin) / half * (i + 0.5)).otherwise(middle + (end - middle) / half * (i + 0.5 - half)))
    centre = F.floor(days / 2)
    others = total(F.transform(line, lambda x, i: F.when((days % 2 == 1) & (i == centre), 0.0).otherwise(x)))
    return F.transform(line, lambda x, i: F.when((days % 2 == 1) & (i == centre), days * this - others).otherwise(x))


def monthly_to_daily(df: DataFrame, keys: list[str], low: float | None = None, high: float | None = None, value: str = "value") -> DataFrame:
    """(keys, year, month, doy, value) from (keys, year, month, value), complete years. The neighbours of January and
    December are in the same year. Minimum first, then maximum."""
    w = W.partitionBy(*keys, "year").orderBy("month")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = F.coalesce(F.lag(value).over(w), F.last(value).over(whole))
    after = F.coalesce(F.lead(value).over(w), F.first(value).over(whole))
    rows = df.withColumns({"_before": before, "_after": after, "_days": F.dayofmonth(F.last_day(F.make_date(F.lit(2001), "month", F.lit(1))))})
    days = month_line(F.col("_before"), F.col(value), F.col("_after"), F.col("_days"))
    rows = rows.withColumn("_line", days)
    if low is not None:
        rows = rows.withColumn("_line", squeeze(F.col("_line"), F.lit(low), True))
    if high is not None:
        rows = rows.withColumn("_line", squeeze(F.col("_line"), F.lit(high), False))
    first = F.dayofyear(F.make_date(F.lit(2001), "month", F.lit(1)))
    out = rows.select(*keys, "year", "month", first.alias("_first"), F.posexplode_outer("_line").alias("_i", "value"))
    return out.select(*keys, "year", "month", (F.col("_first") + F.col("_i")).alias("doy"), "value")


def longwave_bounds(df: DataFrame, mean: str = "lw") -> DataFrame:
    return df.withColumns({f"{mean}_min": F.col(mean) * 0.8, f"{mean}_max": F.col(mean) * 1.2})


def slots(f) -> Column:
    """An array of the 48 half hours of a day, the hour counted at their end."""
    return F.transform(F.sequence(F.lit(1), F.lit(SLOTS)), lambda i: f(i / 2.0))


def solar_geometry(lat: Column, lon: Column, doy: Column) -> Column:
    return slots(lambda hour: S.cos_zenith(lat, lon, doy, hour))


def diurnal_par(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, slot, par, par_mean) from (keys, par_day, doy, cz): the beam's part of the light follows what a clear sky lets
    through, the diffuse part the sun's height. Sums of a day are columns of the day, so that slots only multiply."""
    beam_of = lambda c: F.when((c > 0) & (F.acos(c) < math.radians(80)), c * F.pow(F.lit(CLEAR), F.try_divide(F.lit(1.0), c))).otherwise(0.0)
    days = df.withColumn("_beams", F.transform("cz", beam_of)).withColumns({"_sum_beam": total(F.col("_beams")), "_sum_sky": total(F.col("cz"))})
    rows = days.select(*keys, "par_day", "doy", "_sum_beam", "_sum_sky", F.posexplode_outer(F.arrays_zip("_beams", "cz")).alias("slot", "_z"))
    sky = F.col("_sum_sky") * SOLAR * (1.0 + 0.033 * F.cos(F.col("doy") / 365.0 * 2 * math.pi)) * SLOT_SECONDS * TO_MJ
    diffuse = S.diffuse_fraction(F.coalesce(F.try_divide(F.col("par_day") / PAR_PER_SW, sky), F.lit(1.0)))
    beam = F.when(F.col("_sum_beam") > 0, F.col("par_day") * (1 - diffuse)).otherwise(0.0)
    spread = F.when(F.col("_sum_sky") > 0, F.col("par_day") * diffuse).otherwise(0.0)
    rows = rows.withColumns({"_beam": beam, "_spread": spread})
    share = lambda part, whole, light: F.coalesce(F.try_divide(F.col(part) * F.col(light), F.col(whole)), F.lit(0.0))
    return rows.select(*keys, "slot", (share("_z._beams", "_sum_beam", "_beam") + share("_z.cz", "_sum_sky", "_spread")).alias("par"), ((F.col("_beam") + F.col("_spread")) / float(SLOTS)).alias("par_mean"))


def diurnal_temperature(t_min: Column, t_max: Column, length: Column) -> Column:
    """The 48 temperatures of a day; ``length`` is a column of the day (``S.day_length``)."""
    return slots(lambda hour: S.diurnal_temperature(t_min, t_max, length, hour))


def diurnal_humidity(temperature: Column, pressure: Column, rh: Column) -> Column:
    return F.transform(temperature, lambda t: S.specific_humidity(t, pressure, rh))


def diurnal_vpd(temperature: Column, rh: Column) -> Column:
    return F.transform(temperature, lambda t: S.saturation_pressure(t) * (1.0 - rh))


def diurnal_shortwave(sw_day: Column, par: Column, par_mean: Column) -> Column:
    """A slot's share of the day's mean in the shape of the light; nothing on a dark day."""
    return F.when(par_mean > 0.0001, F.try_divide(sw_day * par, par_mean)).otherwise(0.0)


def diurnal_longwave(df: DataFrame, keys: list[str], low: Column, high: Column, mean: Column) -> DataFrame:
    """(keys, slot, lw) from (keys, t): linear in temperature between the day's bounds, scaled to the day's mean; the mean on a
    day of one temperature (within 1e-6). The mean of a linear function is the function of the mean, so a slot needs no sum."""
    days = df.withColumns({"_low": low, "_high": high, "_mean": mean, "_t0": F.array_min("t"), "_t1": F.array_max("t"), "_avg": total(F.col("t")) / float(SLOTS)})
    rows = days.select(*keys, "_low", "_high", "_mean", "_t0", "_t1", "_avg", F.posexplode_outer("t").alias("slot", "_t"))
    line = lambda t: F.when(F.col("_t1") - F.col("_t0") > 1e-6, F.try_divide((F.col("_high") - F.col("_low")) * F.col(t) - (F.col("_high") * F.col("_t0") - F.col("_low") * F.col("_t1")), F.col("_t1") - F.col("_t0"))).otherwise(F.col("_mean"))
    rows = rows.withColumns({"_raw": line("_t"), "_whole": line("_avg")})
    return rows.select(*keys, "slot", F.when(F.col("_whole") < 0.0001, 0.0).otherwise(F.try_divide(F.col("_raw") * F.col("_mean"), F.col("_whole"))).alias("lw"))


def explode_slots(df: DataFrame, arrays: list[str], keys: list[str]) -> DataFrame:
    """A row for each half hour: keys, slot (from 0), a column for each array."""
    return df.select(*keys, F.posexplode_outer(F.arrays_zip(*arrays)).alias("slot", "_z")).select(*keys, "slot", *[F.col(f"_z.{a}").alias(a) for a in arrays])
