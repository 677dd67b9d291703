"""E, J, H: ensembles, joins, diurnal loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import half_hour_bin
from ..operators import ensemble as E
from ..operators import hysteresis as H
from ..operators import joins as J
from ..operators.reduce import resample_30min
from ..schema import Kind
from ..sources import testbed as T
from ..sources.store import read_scenarios, scratch, write_scenarios
from .book import Book, r_all

book = Book()
add = book.add

STATS = "round(CAST(avg(value) AS DECIMAL(38, 9)), 6)::DOUBLE AS mean, round(CAST(stddev_samp(value) AS DECIMAL(38, 9)), 6)::DOUBLE AS std, round(CAST(median(value) AS DECIMAL(38, 9)), 6)::DOUBLE AS median, round(CAST(quantile_cont(value, 0.25) AS DECIMAL(38, 9)), 6)::DOUBLE AS qlow, round(CAST(quantile_cont(value, 0.75) AS DECIMAL(38, 9)), 6)::DOUBLE AS qup"
BINS = "bins AS (SELECT fid, variable, time_bucket(INTERVAL 30 MINUTE, ts) AS ts, avg(value) AS value FROM model GROUP BY 1, 2, 3)"
OBINS = "obins AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS ts, avg(value) AS value FROM obs GROUP BY 1)"


def bins(s, d):
    return resample_30min(T.model(s, d), ["fid", "variable"]).withColumnRenamed("bin", "ts")


def obs_bins(s, d):
    return resample_30min(T.obs(s, d), []).withColumnRenamed("bin", "ts")


@add("e01_multi_slice", f"SELECT fid, variable, date_trunc('day', ts)::TIMESTAMP AS bucket, {STATS} FROM model WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2, 3", "model")
def _(s, d):
    return r_all(E.multi_slice(T.model(s, d), "2024-01-05", "2024-01-20", Kind.DAILY_SERIES))


@add("e02_multi_slice_layered", f"SELECT fid, \"group\", {STATS} FROM (SELECT fid, step % 5 AS \"group\", CAST(\"values\"[4] AS DOUBLE) AS value FROM layered) GROUP BY 1, 2", "layered")
def _(s, d):
    return r_all(E.multi_slice_layered(T.layered(s, d).withColumn("group", F.col("step") % 5).drop("step"), 3, ["group"]))


@add("e03_multi_slice_avg", """
WITH runs AS (SELECT fid, variable, CAST(month(ts) AS INTEGER) AS bucket, avg(value) AS value FROM daily GROUP BY 1, 2, 3)
SELECT variable, bucket, round(CAST(avg(value) AS DECIMAL(38, 9)), 6)::DOUBLE AS mean, round(CAST(median(value) AS DECIMAL(38, 9)), 6)::DOUBLE AS median, round(CAST(quantile_cont(value, 0.25) AS DECIMAL(38, 9)), 6)::DOUBLE AS qlow, round(CAST(quantile_cont(value, 0.75) AS DECIMAL(38, 9)), 6)::DOUBLE AS qup FROM runs GROUP BY 1, 2""", "daily")
def _(s, d):
    return r_all(E.multi_slice_avg(T.daily(s, d), Kind.MONTHLY_AVG, ["variable"]))


@add("e04_ensemble_band", f"WITH {BINS} SELECT variable, ts, round(CAST(avg(-value) AS DECIMAL(38, 9)), 6)::DOUBLE AS mean, round(CAST(quantile_cont(-value, 0.2) AS DECIMAL(38, 9)), 6)::DOUBLE AS qlow, round(CAST(quantile_cont(-value, 0.8) AS DECIMAL(38, 9)), 6)::DOUBLE AS qup, count(value) AS n FROM bins GROUP BY 1, 2", "model")
def _(s, d):
    return r_all(E.ensemble_band(bins(s, d), ["variable", "ts"], factor=-1.0))


@add("e05_ensemble_quantiles", f"""
WITH {BINS}, each AS (SELECT variable, ts, median(value) AS median, quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.9) AS q90 FROM bins GROUP BY 1, 2)
SELECT variable, date_trunc('day', ts)::TIMESTAMP AS bucket, round(CAST(avg(median) AS DECIMAL(38, 9)), 6)::DOUBLE AS median, round(CAST(avg(q10) AS DECIMAL(38, 9)), 6)::DOUBLE AS q10, round(CAST(avg(q90) AS DECIMAL(38, 9)), 6)::DOUBLE AS q90 FROM each GROUP BY 1, 2""", "model")
def _(s, d):
    return r_all(E.ensemble_quantiles(bins(s, d), F.col("ts"), Kind.DAILY_SERIES, ["variable"]))


@add("e06_split_baseline", "SELECT role, variable, count(*) AS n, round(CAST(avg(value) AS DECIMAL(38, 9)), 6)::DOUBLE AS mean FROM (SELECT *, CASE WHEN fid = 0 THEN 'baseline' ELSE 'ensemble' END AS role FROM model) GROUP BY 1, 2", "model")
def _(s, d):
    return r_all(E.split_baseline(T.model(s, d)).groupBy("role", "variable").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@add("e07_values_at", f"WITH {BINS} SELECT fid, variable, ts, round(CAST(value AS DECIMAL(38, 9)), 6)::DOUBLE AS value FROM bins WHERE ts IN (SELECT TIMESTAMP '2024-01-02 14:00:00' + to_days(CAST(i AS INTEGER)) FROM range(0, 20) t(i))", "model")
def _(s, d):
    at = s.range(20).select((F.lit("2024-01-02 14:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int"))).alias("ts"))
    return r_all(E.values_at(bins(s, d), at)[0].select("fid", "variable", "ts", "value"))


@add("e08_normalize_by_max", "SELECT fid, variable, ts, value, round(value / max(value) OVER (PARTITION BY fid, variable), 6) AS normalized FROM model", "model")
def _(s, d):
    out = E.normalize_by_max(T.model(s, d), ["fid", "variable"])
    return out.select("fid", "variable", "ts", "value", F.round(F.col("normalized"), 6).alias("normalized"))


@add("e09_scenario_stack", """
WITH r AS (SELECT fid, ts, value, CASE WHEN fid % 2 = 0 THEN 'gfdl' ELSE 'ukesm' END AS model, CASE variable WHEN 'A' THEN 'ssp126' WHEN 'N' THEN 'ssp370' ELSE 'ssp585' END AS pathway, CASE WHEN year(ts) < 1996 THEN 'wide' ELSE 'narrow' END AS scenario FROM daily)
SELECT model, pathway, scenario, CAST(CASE model WHEN 'ukesm' THEN 0 ELSE 4 END + CASE pathway WHEN 'ssp370' THEN 0 ELSE 2 END + CASE scenario WHEN 'wide' THEN 0 ELSE 1 END AS INTEGER) AS stack_order, CAST(year(ts) AS INTEGER) AS year, count(*) AS n, round(CAST(avg(value) AS DECIMAL(38, 7)), 4)::DOUBLE AS mean
FROM r WHERE pathway <> 'ssp585' GROUP BY 1, 2, 3, 4, 5""", "daily")
def _(s, d):
    # a folder for each climate model, pathway and constraint set; two of the three pathways are stacked, in an order of their own
    path = scratch(s)
    labels = {"model": F.when(F.col("fid") % 2 == 0, "gfdl").otherwise("ukesm"), "pathway": F.when(F.col("variable") == "A", "ssp126").when(F.col("variable") == "N", "ssp370").otherwise("ssp585"), "scenario": F.when(F.year("ts") < 1996, "wide").otherwise("narrow")}
    write_scenarios(T.daily(s, d).withColumns(labels).select(*labels, "fid", "ts", "value"), path, list(labels))
    stacked = E.scenario_stack(read_scenarios(s, path, "fid INT, ts TIMESTAMP_NTZ, value DOUBLE"), {"model": ["ukesm", "gfdl"], "pathway": ["ssp370", "ssp126"], "scenario": ["wide", "narrow"]})
    return r_all(stacked.groupBy("model", "pathway", "scenario", "stack_order", F.year("ts").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")), 4)


@add("e10_compare_two_ensembles", """
SELECT CASE WHEN fid < 5 THEN 'old' ELSE 'new' END AS ensemble, date_trunc('year', ts)::TIMESTAMP AS bucket, round(CAST(avg(value) AS DECIMAL(38, 9)), 6)::DOUBLE AS mean, round(CAST(median(value) AS DECIMAL(38, 9)), 6)::DOUBLE AS median FROM daily GROUP BY 1, 2""", "daily")
def _(s, d):
    x = T.daily(s, d)
    return r_all(E.compare_ensembles(x.filter("fid < 5"), x.filter("fid >= 5"), Kind.YEARLY_SERIES))


@add("e11_baseline_change_split", "SELECT CASE WHEN year(ts) < 1998 THEN 'baseline' ELSE 'changed' END AS period, CAST(month(ts) AS INTEGER) AS month, round(CAST(avg(value) AS DECIMAL(38, 9)), 6)::DOUBLE AS mean FROM daily GROUP BY 1, 2", "daily")
def _(s, d):
    return r_all(E.change_split(T.daily(s, d), 1998, [F.month("ts").alias("month")]))


@add("a27_progress_summary", "SELECT job, task, CAST(row_number() OVER (PARTITION BY job ORDER BY ts, task) AS INTEGER) AS rank, count(*) OVER (PARTITION BY job) AS total, round(CAST(epoch(ts) - min(epoch(ts) - duration_s) OVER (PARTITION BY job) AS DECIMAL(38, 7)), 4)::DOUBLE AS elapsed_s FROM run_log", "run_log")
def _(s, d):
    return r_all(E.progress(T.run_log(s, d)), 4)


# J: joins


@add("j01_join_model_obs", f"WITH {BINS}, {OBINS} SELECT b.fid, b.variable, b.ts, round(CAST(b.value AS DECIMAL(38, 9)), 6)::DOUBLE AS m, round(CAST(o.value AS DECIMAL(38, 9)), 6)::DOUBLE AS o FROM bins b JOIN obins o USING (ts)", "model obs")
def _(s, d):
    return r_all(J.join_model_obs(bins(s, d), obs_bins(s, d), ["ts"]).select("fid", "variable", "ts", "m", "o"))


@add("j02_align_outer", f"WITH {BINS}, a AS (SELECT ts, avg(value) AS a FROM bins WHERE variable = 'signup' AND fid = 1 GROUP BY 1), b AS (SELECT ts, avg(value) AS b FROM bins WHERE variable = 'signup' AND fid = 2 GROUP BY 1) SELECT ts, round(CAST(a AS DECIMAL(38, 9)), 6)::DOUBLE AS a, round(CAST(b AS DECIMAL(38, 9)), 6)::DOUBLE AS b FROM a FULL JOIN b USING (ts)", "model")
def _(s, d):
    one = lambda k: bins(s, d).filter((F.col("variable") == "signup") & (F.col("fid") == k)).select("ts", "value")
    return r_all(J.align_outer(one(1), one(2), ["ts"]))


@add("j03_join_many", f"WITH {BINS} SELECT fid, ts, round(CAST(max(CASE variable WHEN 'click' THEN value END) AS DECIMAL(38, 9)), 6)::DOUBLE AS click, round(CAST(max(CASE variable WHEN 'purchase' THEN value END) AS DECIMAL(38, 9)), 6)::DOUBLE AS purchase, round(CAST(max(CASE variable WHEN 'signup' THEN value END) AS DECIMAL(38, 9)), 6)::DOUBLE AS signup FROM bins GROUP BY 1, 2 HAVING count(DISTINCT variable) = 3", "model")
def _(s, d):
    return r_all(J.join_many(bins(s, d), ["click", "purchase", "signup"], ["fid", "ts"]))


@add("j04_attach_params", "SELECT fid, disc, tax, qty_sd, size, price, brand FROM scores JOIN params USING (fid)", "scores params")
def _(s, d):
    return J.attach_params(T.scores(s, d), T.params(s, d))


@add("j05_runs_in", "SELECT fid, size, price FROM params WHERE fid IN (SELECT fid FROM scores WHERE disc <= 0.048)", "params scores")
def _(s, d):
    return J.only_in(T.params(s, d).select("fid", "size", "price"), T.scores(s, d).filter("disc <= 0.048"), "fid")


@add("j06_overlap_or_full", f"""
WITH {BINS}, o AS (SELECT DISTINCT ts FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS ts FROM obs WHERE value < 20)),
shifted AS (SELECT fid, variable, CASE WHEN variable = 'signup' THEN ts + INTERVAL 1 YEAR ELSE ts END AS ts, value FROM bins),
hits AS (SELECT s.*, o.ts IS NOT NULL AS seen, sum(CASE WHEN o.ts IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY variable) AS n FROM shifted s LEFT JOIN o ON s.ts = o.ts)
SELECT fid, variable, ts, round(CAST(value AS DECIMAL(38, 9)), 6)::DOUBLE AS value FROM hits WHERE seen OR n = 0""", "model obs")
def _(s, d):
    shifted = bins(s, d).withColumn("ts", F.when(F.col("variable") == "signup", F.col("ts") + F.expr("INTERVAL '1' YEAR")).otherwise(F.col("ts")))
    times = T.obs(s, d).filter("value < 20").select(half_hour_bin(F.col("ts")).alias("ts"))
    return r_all(J.overlap_or_full(shifted, times, ["variable"]).select("fid", "variable", "ts", "value"))


@add("j07_left_join_series", f"WITH {BINS}, {OBINS} SELECT b.fid, b.variable, b.ts, round(CAST(b.value AS DECIMAL(38, 9)), 6)::DOUBLE AS value, round(CAST(o.value AS DECIMAL(38, 9)), 6)::DOUBLE AS lai FROM bins b LEFT JOIN obins o USING (ts)", "model obs")
def _(s, d):
    return r_all(J.left_join_series(bins(s, d), obs_bins(s, d).withColumnRenamed("value", "lai"), ["ts"]).select("fid", "variable", "ts", "value", "lai"))


@add("j08_join_year_doy", "SELECT d.fid, d.variable, d.ts, round(d.value / a.value, 9) AS share FROM daily d JOIN annual a ON year(d.ts) = a.year", "daily annual")
def _(s, d):
    a = T.annual(s, d).withColumnRenamed("value", "a")
    return T.daily(s, d).withColumn("year", F.year("ts")).join(a, "year").select("fid", "variable", "ts", F.round(F.col("value") / F.col("a"), 9).alias("share"))


NEAREST = """glon AS (SELECT DISTINCT lon AS g_lon FROM grid), glat AS (SELECT DISTINCT lat AS g_lat FROM grid),
pt AS (SELECT site, lon, lat, (SELECT arg_min(g_lon, (abs(g_lon - lon), g_lon)) FROM glon) AS g_lon, (SELECT arg_min(g_lat, (abs(g_lat - lat), g_lat)) FROM glat) AS g_lat FROM sites)"""


@add("j09_nearest_cell", f"WITH {NEAREST} SELECT pt.*, round(CAST(g.value AS DECIMAL(38, 9)), 6)::DOUBLE AS value FROM pt LEFT JOIN grid g ON pt.g_lon = g.lon AND pt.g_lat = g.lat", "grid sites")
def _(s, d):
    return r_all(J.nearest_cell(T.sites(s, d), T.grid(s, d)))


@add("j10_nearest_point", """
WITH d AS (SELECT s.site, g.lon AS c_lon, g.lat AS c_lat, (g.lon - s.lon) ** 2 + (g.lat - s.lat) ** 2 AS d2, g.value AS c_value,
  row_number() OVER (PARTITION BY s.site ORDER BY (g.lon - s.lon) ** 2 + (g.lat - s.lat) ** 2, g.lon, g.lat) AS n FROM sites s CROSS JOIN grid g)
SELECT site, c_lon, c_lat, d2, round(CAST(c_value AS DECIMAL(38, 9)), 6)::DOUBLE AS c_value FROM d WHERE n = 1""", "grid sites")
def _(s, d):
    return r_all(J.nearest_point(T.sites(s, d), T.grid(s, d), "site"))


@add("j11_nearest_valid_cell", """
WITH g AS (SELECT CAST((lon + 175) / 10 AS INTEGER) AS ix, CAST((lat + 85) / 10 AS INTEGER) AS iy, value FROM grid),
pt AS (SELECT site, CAST(site % 36 AS INTEGER) AS ix, CAST(site % 18 AS INTEGER) AS iy FROM sites),
steps AS (SELECT 0 AS dx, 0 AS dy, 0 AS priority UNION ALL SELECT r * x, r * y, (r - 1) * 8 + k FROM range(1, 80) t(r), (VALUES (0, -1, 1), (0, 1, 2), (-1, 0, 3), (1, 0, 4), (-1, -1, 5), (1, -1, 6), (-1, 1, 7), (1, 1, 8)) v(x, y, k)),
found AS (SELECT a.site, a.ix, a.iy, CAST(priority AS INTEGER) AS priority, g.value, row_number() OVER (PARTITION BY a.site ORDER BY priority) AS n
  FROM pt a CROSS JOIN steps JOIN g ON g.ix = greatest(a.ix + dx, 0) AND g.iy = greatest(a.iy + dy, 0) AND g.value IS NOT NULL)
SELECT site, ix, iy, priority, round(CAST(value AS DECIMAL(38, 9)), 6)::DOUBLE AS value FROM found WHERE n = 1""", "grid sites")
def _(s, d):
    g = T.grid(s, d).select(((F.col("lon") + 175) / 10).cast("int").alias("ix"), ((F.col("lat") + 85) / 10).cast("int").alias("iy"), "value")
    at = T.sites(s, d).select("site", (F.col("site") % 36).cast("int").alias("ix"), (F.col("site") % 18).cast("int").alias("iy"))
    return r_all(J.nearest_valid_cell(at, g, "site"))


@add("j12_update_join", "SELECT p.fid, p.size, coalesce(s.disc * 1000, p.price) AS price FROM params p LEFT JOIN (SELECT fid, disc FROM scores WHERE disc > 0.05) s USING (fid)", "params scores")
def _(s, d):
    new = T.scores(s, d).filter("disc > 0.05").select("fid", (F.col("disc") * 1000).alias("price"))
    return J.update_join(T.params(s, d).select("fid", "size", "price"), new, ["fid"], ["price"])


@add("j13_common_sites", "SELECT site, lon, lat FROM sites WHERE site IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)", "sites")
def _(s, d):
    a = T.table(s, d, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("site"))
    b = T.table(s, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("site"))
    return J.common_sites(T.sites(s, d), a, b, "site")


@add("j14_cross_design", "SELECT r_name AS model, n_name AS pathway, s_suppkey AS site FROM region CROSS JOIN nation CROSS JOIN supplier")
def _(s, d):
    name = lambda t, c, n: T.table(s, d, t).select(F.col(c).alias(n))
    return J.cross_design(name("region", "r_name", "model"), name("nation", "n_name", "pathway"), name("supplier", "s_suppkey", "site"))


CODES = ["TrBE", "TeBE", "TrBR", "TeBS", "BBS", "BNE", "TeNE", "BNS", "TeH", "TeC", "TrH", "TrC"]


@add("j15_map_plant_type", f"SELECT s_suppkey AS site, ({CODES!r})[s_suppkey % 12 + 1] AS \"PFT\", CAST(([1, 2, 3, 4, 4, 5, 5, 6, 7, 7, 8, 8])[s_suppkey % 12 + 1] AS INTEGER) AS pft_id FROM supplier")
def _(s, d):
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("s_suppkey") % 12 + 1).cast("int"))
    return J.map_codes(T.table(s, d, "supplier").select(F.col("s_suppkey").alias("site"), code.alias("PFT")), J.PLANT_TYPES, "PFT", "pft_id").select("site", "PFT", "pft_id")


# H: diurnal loops

SLOT = "CAST(round_even((hour(ts) + minute(ts) / 60.0::DOUBLE + floor(second(ts)) / 3600.0::DOUBLE) * 2, 0) / 2 AS DOUBLE) % 24.0"
OBS_LOOP = f"ol AS (SELECT {SLOT} AS slot, avg(value) AS mean, quantile_cont(value, 0.2) AS qlow, quantile_cont(value, 0.8) AS qup FROM obs GROUP BY 1)"
MODEL_LOOP = f"""{BINS}, band AS (SELECT variable, ts, avg(value) AS mean, quantile_cont(value, 0.2) AS qlow, quantile_cont(value, 0.8) AS qup FROM bins WHERE ts IN (SELECT time_bucket(INTERVAL 30 MINUTE, ts) FROM obs) GROUP BY 1, 2),
ml AS (SELECT variable, {SLOT} AS slot, avg(mean) AS mean, avg(qlow) AS qlow, avg(qup) AS qup FROM band GROUP BY 1, 2)"""
LOOP = f"""WITH {OBS_LOOP}, {MODEL_LOOP},
both_sides AS (SELECT o.slot, o.mean AS mean_x, o.qlow AS qlow_x, o.qup AS qup_x, m.mean AS mean_y, m.qlow AS qlow_y, m.qup AS qup_y, o.slot AS position FROM ol o JOIN ml m ON o.slot = m.slot AND m.variable = 'click'),
closed AS (SELECT * FROM both_sides UNION ALL (SELECT slot, mean_x, qlow_x, qup_x, mean_y, qlow_y, qup_y, 24.0 FROM both_sides ORDER BY slot LIMIT 1))"""
ROUNDED = ", ".join(f"round(CAST({c}_{s} AS DECIMAL(38, 9)), 6)::DOUBLE AS {c}_{s}" for s in "xy" for c in ("mean", "qlow", "qup"))


def loop(s, d):
    y = H.diurnal_model(bins(s, d), obs_bins(s, d)).filter("variable = 'click'")
    return H.hysteresis_loop(H.diurnal_obs(T.obs(s, d), []), y)


@add("h01_diurnal_obs", f"WITH {OBS_LOOP} SELECT slot, round(CAST(mean AS DECIMAL(38, 9)), 6)::DOUBLE AS mean, round(CAST(qlow AS DECIMAL(38, 9)), 6)::DOUBLE AS qlow, round(CAST(qup AS DECIMAL(38, 9)), 6)::DOUBLE AS qup FROM ol", "obs")
def _(s, d):
    return r_all(H.diurnal_obs(T.obs(s, d), []))


@add("h02_diurnal_model", f"WITH {MODEL_LOOP} SELECT variable, slot, round(CAST(mean AS DECIMAL(38, 9)), 6)::DOUBLE AS mean, round(CAST(qlow AS DECIMAL(38, 9)), 6)::DOUBLE AS qlow, round(CAST(qup AS DECIMAL(38, 9)), 6)::DOUBLE AS qup FROM ml", "model obs")
def _(s, d):
    return r_all(H.diurnal_model(bins(s, d), obs_bins(s, d)))


@add("h03_hysteresis_loop", f"{LOOP} SELECT slot, position, {ROUNDED} FROM closed", "model obs")
def _(s, d):
    return r_all(loop(s, d))


@add("h04_loop_errors", f"{LOOP} SELECT slot, position, " + ", ".join(f"round(CAST(mean_{s} - qlow_{s} AS DECIMAL(38, 9)), 6)::DOUBLE AS low_{s}, round(CAST(qup_{s} - mean_{s} AS DECIMAL(38, 9)), 6)::DOUBLE AS up_{s}" for s in "xy") + " FROM closed", "model obs")
def _(s, d):
    return r_all(H.loop_errors(loop(s, d)).select("slot", "position", "low_x", "up_x", "low_y", "up_y"))


@add("h05_midday_point", f"{LOOP} SELECT slot, position, {ROUNDED} FROM closed WHERE position = 12", "model obs")
def _(s, d):
    return r_all(H.midday_point(loop(s, d)))
