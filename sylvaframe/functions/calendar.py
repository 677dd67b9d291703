"""Time and calendar functions of columns. All of them are closed forms: no state runs from row to row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY, YEAR_365 = 86_400, 365 * 86_400


def truncated(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def plus_seconds(ts: Column, seconds: Column | float) -> Column:
    return (ts + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)") if not isinstance(seconds, Column) else seconds.cast("decimal(18,6)"))).cast("timestamp_ntz")


def plus_micros(ts: Column, micros: Column) -> Column:
    """Adds whole microseconds, also spans of many years."""
    days, rest = F.floor(micros / F.lit(DAY * 1_000_000)), F.pmod(micros, F.lit(DAY * 1_000_000))
    return (ts + F.make_dt_interval(days.cast("int"), F.lit(0), F.lit(0), (rest / 1e6).cast("decimal(18,6)"))).cast("timestamp_ntz")


def noleap_parts(seconds: Column) -> dict[str, Column]:
    """Parts of a time in seconds on a calendar of 365-day years; the year counts from 0, and ``doy`` has a fraction."""
    whole = F.floor(seconds)
    year = F.floor(whole / YEAR_365)
    in_year = whole - year * YEAR_365
    day0 = F.floor(in_year / DAY)
    on = F.date_add(F.lit("2001-01-01").cast("date"), day0.cast("int"))  # 2001 has no leap day
    left = in_year - day0 * DAY
    return {
        "year": year.cast("int"),
        "month": F.month(on),
        "day": F.dayofmonth(on),
        "hour": F.floor(left / 3600).cast("int"),
        "minute": F.floor(F.pmod(left, F.lit(3600)) / 60).cast("int"),
        "second": F.pmod(left, F.lit(60)).cast("int"),
        "doy": (seconds - year * YEAR_365) / DAY + 1,
    }


def noleap_timestamp(seconds: Column, start_year: Column | int) -> Column:
    """The wall-clock time, on the real calendar, of seconds since 1 January of ``start_year`` in 365-day years: no time
    falls on 29 February."""
    p = noleap_parts(seconds)
    start = start_year if isinstance(start_year, Column) else F.lit(start_year)
    return F.make_timestamp_ntz(start + p["year"], p["month"], p["day"], p["hour"], p["minute"], p["second"])


def decode_model_time(seconds: Column, start_year: Column | int, fine: bool) -> tuple[Column, Column]:
    """(timestamp, year): daily or finer output skips 29 February; coarser output has real-calendar dates. Years
    before 1 have no timestamp but an integer year."""
    start = start_year if isinstance(start_year, Column) else F.lit(start_year)
    year = start + F.floor(seconds / YEAR_365).cast("int")
    if fine:
        ts = noleap_timestamp(seconds, start)
    else:
        ts = plus_micros(F.make_timestamp_ntz(start, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), (seconds * 1_000_000).cast("long"))
    return F.when(year >= 1, ts), year.cast("int")


def parse_time_unit(unit: Column) -> Column:
    """The start of ``seconds since Y-M-D h:m[:s]``; other units are an error."""
    pattern = r"^seconds since (-?\d+)-(\d+)-(\d+) (\d+):(\d+)(?::(\d+))?$"
    part = lambda k: F.regexp_extract(unit, pattern, k)
    second = F.when(part(6) == "", F.lit(0)).otherwise(part(6).cast("int"))
    start = F.make_timestamp_ntz(part(1).cast("int"), part(2).cast("int"), part(3).cast("int"), part(4).cast("int"), part(5).cast("int"), second)
    return F.when(unit.rlike(pattern), start).otherwise(F.raise_error(F.concat(F.lit("unknown time unit: "), F.coalesce(unit, F.lit("null")))).cast("timestamp_ntz"))


def fix_first_step(df: DataFrame, keys: list[str], offset: str = "offset", seconds: int = 1800) -> DataFrame:
    """Interval-end stamps to starts: shifts a series whose first offset is above 0."""
    first = F.min(offset).over(W.partitionBy(*keys))
    return df.withColumn(offset, F.when(first > 0, F.col(offset) - seconds).otherwise(F.col(offset)))


def is_leap_day(ts: Column) -> Column:
    return (F.month(ts) == 2) & (F.dayofmonth(ts) == 29)


def noleap_day(ts: Column) -> Column:
    """The day of a 365-day year, by the date: 1 March is the 60th in every year. NULL on 29 February."""
    return F.when(~is_leap_day(ts), F.dayofyear(F.make_date(F.lit(2001), F.month(ts), F.when(~is_leap_day(ts), F.dayofmonth(ts)))))


def drop_leap_days(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.filter(~is_leap_day(F.col(ts)))


def shift_minutes(ts: Column, minutes: int) -> Column:
    return (ts + F.expr(f"INTERVAL '{minutes}' MINUTE")).cast("timestamp_ntz")


def from_year_doy_hour(year: Column, doy: Column, hour: Column) -> Column:
    """Year, day of year (from 1) and decimal hour, to the second."""
    start = F.make_timestamp_ntz(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return (start + F.make_dt_interval((doy - 1).cast("int"), F.lit(0), F.lit(0), F.round(hour * 3600).cast("decimal(18,6)"))).cast("timestamp_ntz")


def decimal_hour(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / 60.0


def calendar_parts(ts: Column) -> dict[str, Column]:
    return {"year": F.year(ts), "month": F.month(ts), "doy": F.dayofyear(ts), "hour": F.hour(ts), "minute": F.minute(ts), "hour_dec": decimal_hour(ts), "date": F.to_date(ts)}


def snap_half_hour(ts: Column) -> Column:
    """The time of day rounded to half hours, ties to even; 24.0 stays."""
    return F.bround((F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0) * 2) / 2


def strip_zone(text: Column) -> Column:
    """``2024-05-01T12:30:00+02:00`` -> its wall-clock time."""
    return F.to_timestamp_ntz(F.translate(F.substring(text, 1, 19), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss"))


def month_sequence(start: Column, n: Column) -> Column:
    """start + n months, days after a month's end moved to its end."""
    return F.add_months(start, n)


def week_index(date: Column) -> Column:
    """Weeks since the epoch (a Thursday starts each), folded to 1..53."""
    return (F.pmod(F.floor(F.unix_date(date) / 7), F.lit(53)) + 1).cast("int")


def at_time_of_day(ts: Column, hour: int = 14) -> Column:
    return (truncated(ts, "day") + F.expr(f"INTERVAL '{hour}' HOUR")).cast("timestamp_ntz")


def half_hour_bin(ts: Column) -> Column:
    return F.window(ts, "30 minutes").getField("start")


def week_ending(ts: Column) -> Column:
    """The Sunday that ends the calendar week."""
    return (truncated(ts, "week") + F.expr("INTERVAL '6' DAY")).cast("timestamp_ntz")
