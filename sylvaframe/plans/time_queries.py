"""T, F and A: time functions, slices, time reductions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import science as S
from ..operators import reduce as A
from ..operators import slices as L
from ..schema import Kind
from ..sources import testbed as T
from .book import Book, r, r_all

book = Book()
add = book.add
SECONDS = "CAST(event_id * 86399 * 7 AS BIGINT)"


# T: calendar


@add("t01_noleap_from_seconds", """
WITH s AS (SELECT event_id, event_id * 604793 AS sec FROM events),
p AS (SELECT event_id, sec, sec // 31536000 AS y, sec % 31536000 AS rest FROM s)
SELECT event_id, CAST(y AS INTEGER) AS year, CAST(month(DATE '2001-01-01' + CAST(rest // 86400 AS INTEGER)) AS INTEGER) AS month,
  CAST(day(DATE '2001-01-01' + CAST(rest // 86400 AS INTEGER)) AS INTEGER) AS day, CAST(rest % 86400 // 3600 AS INTEGER) AS hour,
  CAST(rest % 3600 // 60 AS INTEGER) AS minute, CAST(rest % 60 AS INTEGER) AS second, round(CAST(rest / 86400.0::DOUBLE + 1 AS DECIMAL(38, 9)), 6)::DOUBLE AS doy
FROM p""")
def _(s, d):
    e = T.table(s, d, "events")
    return r(e.select("event_id", *[c.alias(k) for k, c in C.noleap_parts(F.col("event_id") * 604793).items()]), "doy")


@add("t02_decode_model_time", """
WITH s AS (SELECT event_id, event_id * 604793 % 252288000000 AS sec FROM events),
p AS (SELECT event_id, sec, 1900 + sec // 31536000 AS y, DATE '2001-01-01' + CAST(sec % 31536000 // 86400 AS INTEGER) AS d0 FROM s)
SELECT event_id, make_timestamp(y, month(d0), day(d0), sec % 86400 // 3600, sec % 3600 // 60, CAST(sec % 60 AS DOUBLE)) AS fine,
  TIMESTAMP '1900-01-01' + to_seconds(sec) AS coarse, CAST(y AS INTEGER) AS year
FROM p""")
def _(s, d):
    # 8,000 years of seconds, as time stamps end with the year 9999
    e = T.table(s, d, "events").select("event_id", (F.col("event_id") * 604793 % (8000 * C.YEAR_365)).alias("sec"))
    fine, year = C.decode_model_time(F.col("sec"), 1900, True)
    coarse, _ = C.decode_model_time(F.col("sec"), 1900, False)
    return e.select("event_id", fine.alias("fine"), coarse.alias("coarse"), year.alias("year"))


@add("t03_parse_time_unit", "SELECT o_orderkey, make_timestamp(year(o_orderdate), month(o_orderdate), day(o_orderdate), o_orderkey % 24, o_orderkey % 60, 0.0) AS start FROM orders")
def _(s, d):
    o = T.table(s, d, "orders")
    unit = F.concat(F.lit("seconds since "), F.year("o_orderdate"), F.lit("-"), F.month("o_orderdate"), F.lit("-"), F.dayofmonth("o_orderdate"), F.lit(" "), F.col("o_orderkey") % 24, F.lit(":"), F.col("o_orderkey") % 60, F.lit(":00"))
    return o.select("o_orderkey", C.parse_time_unit(unit).alias("start"))


@add("t04_fix_first_step", "SELECT event_id, user_id, CASE WHEN min(event_id % 7) OVER (PARTITION BY user_id) > 0 THEN event_id * 1800 - 1800 ELSE event_id * 1800 END AS shifted FROM events")
def _(s, d):
    # a user's series starts late unless one of its ids is a multiple of seven
    e = T.table(s, d, "events").select("event_id", "user_id", (F.col("event_id") % 7).alias("offset"))
    moved = C.fix_first_step(e, ["user_id"])
    return moved.select("event_id", "user_id", (F.col("event_id") * 1800 + F.when(F.col("offset") < F.col("event_id") % 7, -1800).otherwise(0)).alias("shifted"))


@add("t05_drop_leap_days", "SELECT count(*) AS n, sum(CASE WHEN month(ts) = 2 THEN 1 ELSE 0 END)::BIGINT AS february FROM daily WHERE NOT (month(ts) = 2 AND day(ts) = 29)", "daily")
def _(s, d):
    return C.drop_leap_days(T.daily(s, d)).agg(F.count("*").alias("n"), F.sum(F.when(F.month("ts") == 2, 1).otherwise(0)).alias("february"))


@add("t06_shift_time", "SELECT event_id, ts - INTERVAL 30 MINUTE AS start_30, ts - INTERVAL 15 MINUTE AS start_15 FROM events")
def _(s, d):
    return T.table(s, d, "events").select("event_id", C.shift_minutes(F.col("ts"), -30).alias("start_30"), C.shift_minutes(F.col("ts"), -15).alias("start_15"))


@add("t07_ts_from_ydh", "SELECT event_id, make_timestamp(2024, 1, 1, 0, 0, 0.0) + to_days(CAST(event_id % 366 AS INTEGER)) + to_seconds(event_id % 48 * 1800) AS ts FROM events")
def _(s, d):
    k = F.col("event_id")
    return T.table(s, d, "events").select("event_id", C.from_year_doy_hour(F.lit(2024), (k % 366 + 1).cast("int"), (k % 48) / 2.0).alias("ts"))


@add("t08_calendar_parts", "SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(dayofyear(ts) AS INTEGER) AS doy, CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute, round(CAST(hour(ts) + minute(ts) / 60.0::DOUBLE AS DECIMAL(38, 9)), 6)::DOUBLE AS hour_dec, CAST(ts AS DATE) AS date FROM events")
def _(s, d):
    return r(T.table(s, d, "events").select("event_id", *[c.alias(k) for k, c in C.calendar_parts(F.col("ts")).items()]), "hour_dec")


@add("t09_snap_half_hour", "SELECT event_id, round_even((hour(ts) + minute(ts) / 60.0::DOUBLE + floor(second(ts)) / 3600.0::DOUBLE) * 2, 0) / 2 AS slot FROM events")
def _(s, d):
    return T.table(s, d, "events").select("event_id", C.snap_half_hour(F.col("ts")).alias("slot"))


@add("t10_strip_zone", "SELECT event_id, date_trunc('second', ts) AS ts FROM events")
def _(s, d):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    return T.table(s, d, "events").select("event_id", C.strip_zone(text).alias("ts"))


@add("t11_month_sequence", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + to_months(CAST(o_orderkey % 30 AS INTEGER)) AS DATE) AS due FROM orders")
def _(s, d):
    return T.table(s, d, "orders").select("o_orderkey", C.month_sequence(F.to_date("o_orderdate"), (F.col("o_orderkey") % 30).cast("int")).alias("due"))


@add("t12_week_index", "SELECT o_orderkey, CAST((CAST(o_orderdate AS DATE) - DATE '1970-01-01') // 7 % 53 + 1 AS INTEGER) AS week FROM orders")
def _(s, d):
    return T.table(s, d, "orders").select("o_orderkey", C.week_index(F.to_date("o_orderdate")).alias("week"))


@add("t13_fixed_time_of_day", "SELECT event_id, date_trunc('day', ts)::TIMESTAMP + INTERVAL 14 HOUR AS ts FROM events")
def _(s, d):
    return T.table(s, d, "events").select("event_id", C.at_time_of_day(F.col("ts")).alias("ts"))


# F: slices and projections


@add("f01_slice_dates", "SELECT fid, variable, ts, value FROM model WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'", "model")
def _(s, d):
    return L.slice_dates(T.model(s, d), "2024-01-08", "2024-01-15")


@add("f02_slice_years", "SELECT fid, variable, count(*) AS n, CAST(min(ts) AS TIMESTAMP) AS first, CAST(max(ts) AS TIMESTAMP) AS last FROM daily WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1998-01-01' GROUP BY 1, 2", "daily")
def _(s, d):
    return L.slice_years(T.daily(s, d), 1996, 1998).groupBy("fid", "variable").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@add("f02_slice_years_months", "SELECT fid, variable, count(*) AS n FROM daily WHERE ts >= TIMESTAMP '1996-03-01' AND ts < TIMESTAMP '1997-11-01' GROUP BY 1, 2", "daily")
def _(s, d):
    return L.slice_years_months(T.daily(s, d), (1996, 3), (1997, 11)).groupBy("fid", "variable").agg(F.count("*").alias("n"))


@add("f03_select_layer", "SELECT fid, step, CAST(\"values\"[6] AS DOUBLE) AS value FROM layered", "layered")
def _(s, d):
    return L.select_layer(T.layered(s, d), 5)


@add("f04_select_runs", "SELECT fid, variable, count(*) AS n, round(CAST(sum(value) AS DECIMAL(38, 7)), 4)::DOUBLE AS total FROM model WHERE fid IN (1, 4, 6) GROUP BY 1, 2", "model")
def _(s, d):
    return r(L.select_runs(T.model(s, d), [1, 4, 6]).groupBy("fid", "variable").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total", digits=4)


@add("f05_season_filter", "SELECT fid, variable, ts, value FROM model WHERE month(ts) = 1 AND hour(ts) IN (12, 13, 14)", "model")
def _(s, d):
    return L.season_filter(T.model(s, d), [1], [12, 13, 14])


@add("f06_constrain", "SELECT fid, disc, tax, qty_sd FROM scores WHERE disc <= 0.05 AND tax <= 0.045 AND qty_sd BETWEEN 10 AND 16", "scores")
def _(s, d):
    return L.constrain(T.scores(s, d), {"disc": 0.05, "tax": 0.045, "qty_sd": (10.0, 16.0)})


@add("f07_drop_empty_columns", "SELECT fid, size, price, brand FROM params", "params")
def _(s, d):
    return L.drop_empty_columns(T.params(s, d).withColumns({"nothing": F.lit(None).cast("double"), "nan": F.lit(float("nan"))}))


@add("f09_clean_sensor", "SELECT ts, props AS id, (value / -10.0) * 0.1 AS psi FROM events WHERE contains(props, '1') AND value / -10.0 BETWEEN -40 AND 0 AND ts < TIMESTAMP '2024-01-20'")
def _(s, d):
    raw = T.table(s, d, "events").select("ts", F.col("props").alias("id"), (F.col("value") / -10.0).alias("psi"))
    return L.clean_sensor(raw, "1", "2024-01-20")


@add("f10_clamp_low", "SELECT c_custkey, greatest(c_acctbal, 0.1) AS acctbal FROM customer")
def _(s, d):
    return L.clamp_low(T.table(s, d, "customer").select("c_custkey", F.col("c_acctbal").alias("acctbal")), {"acctbal": 0.1})


@add("f11_keep_two_windows", "SELECT fid, variable, ts, value FROM model WHERE (ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-06') OR ts >= TIMESTAMP '2024-01-25'", "model")
def _(s, d):
    return L.in_windows(T.model(s, d), [("2024-01-03", "2024-01-06"), ("2024-01-25", None)])


@add("f12_combine_terms", "SELECT fid, bin, round(CAST(sum(CASE variable WHEN 'click' THEN value ELSE -value END) AS DECIMAL(38, 9)), 6)::DOUBLE AS value, 'nee' AS variable FROM bins WHERE variable IN ('click', 'signup') GROUP BY fid, bin HAVING count(DISTINCT variable) = 2".replace("FROM bins", "FROM (SELECT fid, variable, time_bucket(INTERVAL 30 MINUTE, ts) AS bin, avg(value) AS value FROM model GROUP BY 1, 2, 3)"), "model")
def _(s, d):
    bins = A.resample_30min(T.model(s, d), ["fid", "variable"])
    return r(L.combine_terms(bins, "nee", (("click", 1.0), ("signup", -1.0)), ["fid", "bin"]), "value")


@add("f13_convert_units", "SELECT event_id, round(CAST(value * (1e6 / 0.01201) AS DECIMAL(38, 6)), 3)::DOUBLE AS flux, value * 0.1 AS mpa, round(CAST(value - 273.15 AS DECIMAL(38, 9)), 6)::DOUBLE AS celsius FROM events")
def _(s, d):
    v = F.col("value")
    out = T.table(s, d, "events").select("event_id", S.convert(v, "kg C m-2 s-1", "micro mol m-2 s-1").alias("flux"), S.convert(v, "bar", "MPa").alias("mpa"), S.convert(v, "K", "deg C").alias("celsius"))
    return r(r(out, "flux", digits=3), "celsius")


@add("f14_vpd", """
SELECT l_orderkey, l_linenumber, round(CAST(greatest(0.0, 0.61078 * exp(17.27 * l_quantity / (l_quantity + 237.3)) - (l_tax * 100 / 1000.0) * (1013.0 / 10.0) / (0.622 + 0.378 * (l_tax * 100 / 1000.0))) AS DECIMAL(38, 9)), 6)::DOUBLE AS vpd FROM lineitem""")
def _(s, d):
    return r(T.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", S.vpd(F.col("l_quantity") + 273.15, F.col("l_tax") * 100, F.lit(1013.0)).alias("vpd")), "vpd")


@add("f15_conductivity", "SELECT p_partkey, round(CAST(1e9 * CASE WHEN p_size / 45.4::DOUBLE > 1 THEN 4.6e-7 ELSE 4.6e-7 * pow(p_size / 45.4::DOUBLE, 17.8) END AS DECIMAL(38, 9)), 6)::DOUBLE AS k_nano FROM part")
def _(s, d):
    return r(T.table(s, d, "part").select("p_partkey", (1e9 * S.conductivity(F.col("p_size").cast("double"))).alias("k_nano")), "k_nano")


@add("f17_extract_site_id", "SELECT s_suppkey, 'DE-' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') AS site FROM supplier")
def _(s, d):
    path = F.concat(F.lit("/data/forcing/DE-"), F.lpad((F.col("s_suppkey") % 1000).cast("string"), 3, "0"), F.lit("_1901-2000.dat"))
    return T.table(s, d, "supplier").select("s_suppkey", L.site_of_path(path).alias("site"))


@add("f18_ramp_change", "SELECT year, month, round(CAST(greatest(value + CASE WHEN year > 1997 THEN ((year - 1998) * 12 + month - 1) / 12.0::DOUBLE / 3 * -50000 ELSE 0 END, 0) AS DECIMAL(38, 7)), 4)::DOUBLE AS value FROM months", "months")
def _(s, d):
    return r(L.ramp_change(T.months(s, d), -50000.0, 3, 2000, floor=0.0), "value", digits=4)


@add("f19_snap_coordinate", "SELECT site, least(175.0, greatest(-175.0, round_even((lon + 175) / 10, 0) * 10 - 175)) AS g_lon, least(85.0, greatest(-85.0, round_even((lat + 85) / 10, 0) * 10 - 85)) AS g_lat FROM sites", "sites")
def _(s, d):
    return T.sites(s, d).select("site", L.snap_coordinate(F.col("lon"), 10.0, -175.0, -175.0, 175.0).alias("g_lon"), L.snap_coordinate(F.col("lat"), 10.0, -85.0, -85.0, 85.0).alias("g_lat"))


# A: time reductions

STATS = "round(CAST(avg(value) AS DECIMAL(38, 9)), 6)::DOUBLE AS mean, round(CAST(stddev_samp(value) AS DECIMAL(38, 9)), 6)::DOUBLE AS std, round(CAST(median(value) AS DECIMAL(38, 9)), 6)::DOUBLE AS median, round(CAST(quantile_cont(value, 0.25) AS DECIMAL(38, 9)), 6)::DOUBLE AS qlow, round(CAST(quantile_cont(value, 0.75) AS DECIMAL(38, 9)), 6)::DOUBLE AS qup"
BUCKETS = {
    Kind.HOURLY_SERIES: ("a02", "model", "date_trunc('hour', ts)::TIMESTAMP"),
    Kind.DAILY_SERIES: ("a03", "model", "date_trunc('day', ts)::TIMESTAMP"),
    Kind.WEEKLY_SERIES: ("a04", "model", "date_trunc('week', ts)::TIMESTAMP + INTERVAL 6 DAY"),
    Kind.MONTHLY_SERIES: ("a05", "daily", "date_trunc('month', ts)::TIMESTAMP"),
    Kind.YEARLY_SERIES: ("a06", "daily", "date_trunc('year', ts)::TIMESTAMP"),
    Kind.THIRTY_MIN_AVG: ("a07", "model", "CAST((hour(ts) * 60 + minute(ts)) // 30 * 30 AS INTEGER)"),
    Kind.HOURLY_AVG: ("a08", "model", "CAST(hour(ts) AS INTEGER)"),
    Kind.DAILY_AVG: ("a09", "daily", "CAST(dayofyear(ts) AS INTEGER)"),
    Kind.MONTHLY_AVG: ("a10", "daily", "CAST(month(ts) AS INTEGER)"),
    Kind.WEEKLY_AVG: ("a11", "daily", "CAST((CAST(ts AS DATE) - DATE '1970-01-01') // 7 % 53 + 1 AS INTEGER)"),
    Kind.MONTH_DAY_AVG: ("a12", "daily", "CAST(month(ts) * 100 + day(ts) AS INTEGER)"),
}
for kind, (number, name, expression) in BUCKETS.items():
    add(f"{number}_{kind.value}", f"SELECT fid, variable, {expression} AS bucket, {STATS} FROM {name} GROUP BY 1, 2, 3", name)(lambda s, d, kind=kind, name=name: r_all(A.reduce_time(getattr(T, name)(s, d), kind, ["fid", "variable"])))


@add("a00_summarize_value", f"SELECT fid, variable, {STATS} FROM model GROUP BY 1, 2", "model")
def _(s, d):
    return r_all(T.model(s, d).groupBy("fid", "variable").agg(*A.summary()))


@add("a01_thirty_min_series", "SELECT fid, variable, ts AS bucket, value AS mean FROM model", "model")
def _(s, d):
    return A.reduce_time(T.model(s, d), Kind.THIRTY_MIN_SERIES, ["fid", "variable"])


@add("a13_day_quantiles", "SELECT variable, CAST((hour(ts) * 60 + minute(ts)) // 30 * 30 AS INTEGER) AS bucket, round(CAST(quantile_cont(value, 0.2) AS DECIMAL(38, 9)), 6)::DOUBLE AS q20, round(CAST(quantile_cont(value, 0.8) AS DECIMAL(38, 9)), 6)::DOUBLE AS q80 FROM model GROUP BY 1, 2", "model")
def _(s, d):
    return r_all(A.day_quantiles(T.model(s, d), [0.2, 0.8], ["variable"]))


@add("a14_seasonal_yearly", """
WITH band AS (SELECT variable, ts, median(value) AS median, quantile_cont(value, 0.25) AS qlow, quantile_cont(value, 0.75) AS qup FROM daily GROUP BY 1, 2)
SELECT variable, CAST(year(ts) AS INTEGER) AS year, round(CAST(avg(median) AS DECIMAL(38, 7)), 4)::DOUBLE AS median, round(CAST(avg(qlow) AS DECIMAL(38, 7)), 4)::DOUBLE AS qlow, round(CAST(avg(qup) AS DECIMAL(38, 7)), 4)::DOUBLE AS qup FROM band WHERE month(ts) BETWEEN 5 AND 9 GROUP BY 1, 2""", "daily")
def _(s, d):
    band = T.daily(s, d).groupBy("variable", "ts").agg(F.median("value").alias("median"), F.percentile("value", 0.25).alias("qlow"), F.percentile("value", 0.75).alias("qup"))
    return r_all(A.seasonal_yearly(band, [5, 6, 7, 8, 9], ["variable"], ["median", "qlow", "qup"]), 4)


@add("a15_window_means", """
WITH w AS (SELECT unnest([1995, 1997, 1999]) AS y)
SELECT fid, variable, CAST(y AS INTEGER) AS "window", round(CAST(avg(value) AS DECIMAL(38, 7)), 4)::DOUBLE AS mean FROM daily JOIN w ON ts >= make_timestamp(y, 1, 1, 0, 0, 0) AND ts < make_timestamp(y + 2, 12, 31, 0, 0, 0)
WHERE month(ts) = 8 GROUP BY 1, 2, 3""", "daily")
def _(s, d):
    return r_all(A.window_means(T.daily(s, d), 1995, 1999, 2, 2, 8, ["fid", "variable"]), 4)


@add("a16_last_row_snapshots", "SELECT fid, variable, CAST(year(ts) AS INTEGER) AS year, arg_max(value, (ts, value)) AS value, max(ts) AS ts FROM daily WHERE year(ts) IN (1996, 1999) GROUP BY 1, 2, 3", "daily")
def _(s, d):
    return A.last_rows(T.daily(s, d).filter(F.year("ts").isin(1996, 1999)).withColumn("year", F.year("ts")), ["fid", "variable", "year"])


@add("a17_last_value", "SELECT fid, arg_max(value, (ts, value)) AS value, max(ts) AS ts FROM model GROUP BY 1", "model")
def _(s, d):
    return A.last_rows(T.model(s, d), ["fid"])


@add("a18_masked_mean", "SELECT fid, round(CAST(avg(CASE WHEN month(ts) = 8 AND day(ts) < 15 THEN value END) AS DECIMAL(38, 7)), 4)::DOUBLE AS mean FROM daily GROUP BY 1", "daily")
def _(s, d):
    return r_all(A.masked_mean(T.daily(s, d), (F.month("ts") == 8) & (F.dayofmonth("ts") < 15), ["fid"]), 4)


@add("a19_year_difference", "SELECT fid, variable, round(CAST(avg(CASE WHEN year(ts) = 2000 THEN value END) - avg(CASE WHEN year(ts) = 1996 THEN value END) AS DECIMAL(38, 7)), 4)::DOUBLE AS difference FROM daily GROUP BY 1, 2", "daily")
def _(s, d):
    return r_all(A.year_difference(T.daily(s, d), 1996, 2000, ["fid", "variable"]), 4)


@add("a20_period_total", """
WITH days AS (SELECT fid, variable, date_trunc('day', ts) AS day, avg(value) AS v FROM daily WHERE month(ts) BETWEEN 5 AND 9 GROUP BY 1, 2, 3)
SELECT fid, variable, CAST(year(day) AS INTEGER) AS year, round(CAST(sum(v) AS DECIMAL(38, 5)), 2)::DOUBLE AS total, year(any_value(day)) IN (1997, 1999) AS chosen FROM days GROUP BY 1, 2, 3""", "daily")
def _(s, d):
    return r_all(A.period_total(T.daily(s, d), [5, 6, 7, 8, 9], ["fid", "variable"], [1997, 1999]), 2)


@add("a21_subset_means", """
SELECT 'year' AS part, CAST(year(ts) AS DOUBLE) AS key, round(CAST(avg(value) AS DECIMAL(38, 9)), 6)::DOUBLE AS mean FROM model GROUP BY 2
UNION ALL SELECT 'doy', CAST(dayofyear(ts) AS DOUBLE), round(CAST(avg(value) AS DECIMAL(38, 9)), 6)::DOUBLE FROM model GROUP BY 2
UNION ALL SELECT 'hour', round(CAST(hour(ts) + minute(ts) / 60.0::DOUBLE AS DECIMAL(38, 9)), 6)::DOUBLE, round(CAST(avg(value) AS DECIMAL(38, 9)), 6)::DOUBLE FROM model GROUP BY 2""", "model")
def _(s, d):
    return r_all(A.subset_means(T.model(s, d)))


@add("a22_replicate_mean", """
SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS prefix, round(CAST(avg((coalesce(nullif(l_discount, 0.0), 0) + l_tax + l_quantity) / (CASE WHEN l_discount = 0 THEN 2 ELSE 3 END)) * -0.1 AS DECIMAL(38, 9)), 6)::DOUBLE AS mean FROM lineitem GROUP BY 1, 2""")
def _(s, d):
    x = T.table(s, d, "lineitem").select(F.to_date("l_shipdate").alias("date"), F.split_part(F.concat("l_returnflag", F.lit("_1")), F.lit("_"), F.lit(1)).alias("prefix"), F.nullif(F.col("l_discount"), F.lit(0.0)).alias("r1"), F.col("l_tax").alias("r2"), F.col("l_quantity").alias("r3"))
    return r_all(A.replicate_mean(x, ["r1", "r2", "r3"], ["date", "prefix"]))


@add("a23_group_quantiles", "SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS bin, round(CAST(quantile_cont(value, 0.1) AS DECIMAL(38, 9)), 6)::DOUBLE AS J0_1, round(CAST(quantile_cont(value, 0.5) AS DECIMAL(38, 9)), 6)::DOUBLE AS J0_5, round(CAST(quantile_cont(value, 0.9) AS DECIMAL(38, 9)), 6)::DOUBLE AS J0_9 FROM model GROUP BY 1", "model")
def _(s, d):
    return r_all(A.group_quantiles(T.model(s, d).withColumn("bin", C.half_hour_bin(F.col("ts"))), [0.1, 0.5, 0.9], ["bin"]))


@add("a24_resample_30min", "SELECT fid, variable, time_bucket(INTERVAL 30 MINUTE, ts) AS bin, round(CAST(avg(value) AS DECIMAL(38, 9)), 6)::DOUBLE AS value FROM model GROUP BY 1, 2, 3", "model")
def _(s, d):
    return r_all(A.resample_30min(T.model(s, d), ["fid", "variable"]))


@add("a25_coarser_band", """
WITH band AS (SELECT variable, time_bucket(INTERVAL 30 MINUTE, ts) AS ts, avg(value) AS mean, quantile_cont(value, 0.2) AS qlow, quantile_cont(value, 0.8) AS qup FROM model GROUP BY 1, 2)
SELECT variable, date_trunc('day', ts)::TIMESTAMP AS bucket, round(CAST(avg(mean) AS DECIMAL(38, 9)), 6)::DOUBLE AS mean, round(CAST(avg(qlow) AS DECIMAL(38, 9)), 6)::DOUBLE AS qlow, round(CAST(avg(qup) AS DECIMAL(38, 9)), 6)::DOUBLE AS qup FROM band GROUP BY 1, 2""", "model")
def _(s, d):
    m = T.model(s, d).select("variable", C.half_hour_bin(F.col("ts")).alias("ts"), "value")
    band = m.groupBy("variable", "ts").agg(F.avg("value").alias("mean"), F.percentile("value", 0.2).alias("qlow"), F.percentile("value", 0.8).alias("qup"))
    return r_all(A.coarser_band(band, "day", ["mean", "qlow", "qup"], ["variable"]))


@add("a26_long_history_yearly", "SELECT CAST(-500 + event_id * 604793 // 31536000 AS INTEGER) AS year, round(CAST(avg(value) AS DECIMAL(38, 9)), 6)::DOUBLE AS mean FROM events GROUP BY 1")
def _(s, d):
    return r_all(A.long_history_yearly(T.table(s, d, "events").select((F.col("event_id") * 604793).alias("offset"), "value"), -500))
