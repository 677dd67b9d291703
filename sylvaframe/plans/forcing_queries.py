"""G, D, X: forcing tables, downscaling, designs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import science as S
from ..operators import design as X
from ..operators import downscale as D
from ..operators import forcing as G
from ..operators import joins as J
from ..sources import testbed as T
from .book import Book, r, r_all
from .ensemble_queries import CODES, NEAREST

book = Book()
add = book.add
DOY = "days AS (SELECT CAST(i + 1 AS INTEGER) AS doy, CAST(month(DATE '2001-01-01' + CAST(i AS INTEGER)) AS INTEGER) AS month FROM range(0, 365) t(i))"
DEP = "dep AS (SELECT s.site, f.family, m.year, m.month, m.value * s.site * f.k / 1e15 AS value FROM months m CROSS JOIN sites s CROSS JOIN (VALUES ('historic', 1.0), ('rcp85', 2.0)) f(family, k))"


def deposition(s, d):
    sites = J.spread(T.sites(s, d).select("site"))
    families = s.createDataFrame([("historic", 1.0), ("rcp85", 2.0)], "family STRING, k DOUBLE")
    return sites.crossJoin(F.broadcast(T.months(s, d))).crossJoin(F.broadcast(families)).select("site", "family", "year", "month", (F.col("value") * F.col("site") * F.col("k") / 1e15).alias("value"))


@add("g01_n_deposition", f"WITH {DOY}, {DEP} SELECT site, year, doy, round(CAST(value * 86400 * 1e6 AS DECIMAL(38, 9)), 6)::DOUBLE AS value FROM dep JOIN days USING (month) WHERE family = CASE WHEN year < 1996 THEN 'historic' ELSE 'rcp85' END", "months sites")
def _(s, d):
    return r_all(G.n_deposition(deposition(s, d), "rcp85"))


@add("g02_p_deposition", f"WITH {NEAREST} SELECT site, round(CAST(g.value / 365 AS DECIMAL(38, 9)), 6)::DOUBLE AS p_srf_down FROM pt LEFT JOIN grid g ON pt.g_lon = g.lon AND pt.g_lat = g.lat", "grid sites")
def _(s, d):
    return r_all(G.p_deposition(T.sites(s, d), T.grid(s, d)).select("site", "p_srf_down"))


@add("g03_map_lookup", f"WITH {NEAREST} SELECT site, round(CAST(g.value / 100 AS DECIMAL(38, 9)), 6)::DOUBLE AS value FROM pt LEFT JOIN grid g ON pt.g_lon = g.lon AND pt.g_lat = g.lat", "grid sites")
def _(s, d):
    return r_all(G.map_lookup(T.sites(s, d), T.grid(s, d), 0.01).select("site", "value"))


@add("g04_p_pools", """
WITH g AS (SELECT map, CAST((lon + 175) / 10 AS INTEGER) AS ix, CAST((lat + 85) / 10 AS INTEGER) AS iy, value * k AS value FROM grid CROSS JOIN (VALUES ('labile', 1.0), ('slow', 2.0), ('occluded', 3.0), ('primary', 4.0)) m(map, k)),
pt AS (SELECT site, CAST(site % 36 AS INTEGER) AS ix, CAST(site % 18 AS INTEGER) AS iy FROM sites),
steps AS (SELECT 0 AS dx, 0 AS dy, 0 AS priority UNION ALL SELECT r * x, r * y, (r - 1) * 8 + k FROM range(1, 80) t(r), (VALUES (0, -1, 1), (0, 1, 2), (-1, 0, 3), (1, 0, 4), (-1, -1, 5), (1, -1, 6), (-1, 1, 7), (1, 1, 8)) v(x, y, k)),
found AS (SELECT a.site, g.map, g.value, row_number() OVER (PARTITION BY a.site, g.map ORDER BY priority) AS n
  FROM pt a CROSS JOIN steps JOIN g ON g.ix = greatest(a.ix + dx, 0) AND g.iy = greatest(a.iy + dy, 0) AND g.value IS NOT NULL)
SELECT site, round(CAST(max(CASE map WHEN 'labile' THEN value END) AS DECIMAL(38, 9)), 6)::DOUBLE AS labile, round(CAST(max(CASE map WHEN 'slow' THEN value END) AS DECIMAL(38, 9)), 6)::DOUBLE AS slow, round(CAST(max(CASE map WHEN 'occluded' THEN value END) AS DECIMAL(38, 9)), 6)::DOUBLE AS occluded, round(CAST(max(CASE map WHEN 'primary' THEN value END) AS DECIMAL(38, 9)), 6)::DOUBLE AS "primary", 0.5::DOUBLE AS depth FROM found WHERE n = 1 GROUP BY 1""", "grid sites")
def _(s, d):
    g = T.grid(s, d).select(((F.col("lon") + 175) / 10).cast("int").alias("ix"), ((F.col("lat") + 85) / 10).cast("int").alias("iy"), "value")
    at = T.sites(s, d).select("site", (F.col("site") % 36).cast("int").alias("ix"), (F.col("site") % 18).cast("int").alias("iy"))
    maps = g.select("ix", "iy", F.explode(F.array(*[F.struct(F.lit(name).alias("map"), (F.col("value") * float(k + 1)).alias("value")) for k, name in enumerate(G.PHOSPHORUS_POOLS)])).alias("m")).select("ix", "iy", "m.*")
    return r_all(G.p_pools(at, maps))


@add("g05_add_co2", "SELECT m.year, m.month, round(CAST(m.value AS DECIMAL(38, 7)), 4)::DOUBLE AS value, round(CAST(a.value AS DECIMAL(38, 7)), 4)::DOUBLE AS co2 FROM months m JOIN annual a USING (year)", "months annual")
def _(s, d):
    return r_all(G.add_annual(T.months(s, d), T.annual(s, d), "co2"), 4)


@add("g06_add_c14", "SELECT s.site, s.lat, a.year, round(CAST(CASE WHEN lat > 30 THEN value WHEN lat > -30 THEN value * 2 ELSE value * 3 END AS DECIMAL(38, 7)), 4)::DOUBLE AS \"co2DC14\" FROM sites s CROSS JOIN annual a", "sites annual")
def _(s, d):
    a = T.annual(s, d)
    bands = a.select("year", F.col("value").alias("north"), (F.col("value") * 2).alias("tropics"), (F.col("value") * 3).alias("south"))
    return r_all(G.add_c14(T.sites(s, d).select("site", "lat").crossJoin(a.select("year")), bands).select("site", "lat", "year", "co2DC14"), 4)


#: Years of 365 days: 29 February goes, every other day has the number that it has in a common year.
MET = "met AS (SELECT l_suppkey AS site, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(dayofyear(make_date(2001, month(l_shipdate), day(l_shipdate))) AS INTEGER) AS doy, avg(l_quantity) AS t_air, avg(l_tax) AS wind_air FROM lineitem WHERE NOT (month(l_shipdate) = 2 AND day(l_shipdate) = 29) GROUP BY 1, 2, 3)"
ASSEMBLED = ("site", "year", "doy", "t_air", "wind_air", "co2_mixing_ratio", "co2_dC13", "co2DC14", "nhx_srf_down", "noy_srf_down", "p_srf_down")


@add("g07_assemble_forcing", f"""
WITH {DOY}, {DEP}, {MET}, n AS (SELECT site, year, doy, value * 86400 * 1e6 AS value FROM dep JOIN days USING (month) WHERE family = CASE WHEN year < 1996 THEN 'historic' ELSE 'rcp85' END)
SELECT met.site, met.year, met.doy, round(CAST(t_air AS DECIMAL(38, 9)), 6)::DOUBLE AS t_air, round(CAST(greatest(wind_air, 0.1) AS DECIMAL(38, 9)), 6)::DOUBLE AS wind_air, round(CAST(a.value AS DECIMAL(38, 7)), 4)::DOUBLE AS co2_mixing_ratio, round(CAST(a.value / 10 AS DECIMAL(38, 7)), 4)::DOUBLE AS "co2_dC13",
  round(CAST(CASE WHEN s.lat > 30 THEN a.value WHEN s.lat > -30 THEN a.value * 2 ELSE a.value * 3 END AS DECIMAL(38, 7)), 4)::DOUBLE AS "co2DC14", round(CAST(n.value AS DECIMAL(38, 9)), 6)::DOUBLE AS nhx_srf_down, round(CAST(n.value * 2 AS DECIMAL(38, 9)), 6)::DOUBLE AS noy_srf_down, met.site / 365.0::DOUBLE AS p_srf_down
FROM met JOIN sites s USING (site) JOIN annual a USING (year) JOIN n ON n.site = met.site AND n.year = met.year AND n.doy = met.doy""", "months sites annual")
def _(s, d):
    rows = C.drop_leap_days(T.table(s, d, "lineitem"), "l_shipdate").groupBy(F.col("l_suppkey").alias("site"), F.year("l_shipdate").alias("year"), C.noleap_day(F.col("l_shipdate")).alias("day"))
    met = rows.agg(F.avg("l_quantity").alias("t_air"), F.avg("l_tax").alias("wind_air")).join(T.sites(s, d).select("site", "lat"), "site")
    a = T.annual(s, d)
    times = lambda k: a.withColumn("value", F.col("value") * k)
    c14 = a.select("year", F.col("value").alias("north"), (F.col("value") * 2).alias("tropics"), (F.col("value") * 3).alias("south"))
    n = G.monthly_deposition(deposition(s, d), "rcp85")
    p = T.sites(s, d).select("site", (F.col("site") / 365.0).alias("p_srf_down"))
    out = G.assemble(met, a, times(0.1), c14, n, n.withColumn("value", F.col("value") * 2), p, ASSEMBLED[1:])
    co2 = [c for c in ASSEMBLED if c.startswith("co2")]
    return r(r(out, *co2, digits=4), *[c for c in ASSEMBLED[3:-1] if c not in co2])


@add("g08_assert_complete", "SELECT l_suppkey AS site, CAST(sum(CASE WHEN l_discount = 0 OR l_tax = 0 THEN 1 ELSE 0 END) AS BIGINT) AS missing, sum(CASE WHEN l_discount = 0 OR l_tax = 0 THEN 1 ELSE 0 END) = 0 AS ok FROM lineitem GROUP BY 1")
def _(s, d):
    x = T.table(s, d, "lineitem").select(F.col("l_suppkey").alias("site"), F.nullif(F.col("l_discount"), F.lit(0.0)).alias("a"), F.when(F.col("l_tax") == 0, float("nan")).otherwise(F.col("l_tax")).alias("b"))
    return G.complete_sites(x, ["a", "b"])


DIGITS = "CAST('0x' || substr(md5({0}), 1, 13) AS BIGINT)"  # as operators.design.hashed


@add("g09_fill_lai", f"""
WITH gaps AS (SELECT l_suppkey % 3 AS site, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(dayofyear(l_shipdate) AS INTEGER) AS doy, CASE WHEN year(l_shipdate) % 3 = 0 AND dayofyear(l_shipdate) % 2 = 0 THEN NULL ELSE avg(l_quantity) END AS lai, 0.0::DOUBLE AS hour
  FROM lineitem GROUP BY l_suppkey % 3, year(l_shipdate), dayofyear(l_shipdate)),
years AS (SELECT site, year, count(lai) AS n, count(*) AS total FROM gaps GROUP BY 1, 2),
have AS (SELECT site, list(year ORDER BY year) AS have FROM years WHERE n > 0 GROUP BY 1),
donors AS (SELECT y.site, y.year, have[{DIGITS.format("'42|' || y.site || '|' || y.year")} % len(have) + 1] AS donor FROM years y JOIN have USING (site) WHERE n < total),
given AS (SELECT d.site, d.year, g.doy, g.hour, g.lai FROM donors d JOIN gaps g ON g.site = d.site AND g.year = d.donor),
filled AS (SELECT g.site, g.year, g.doy, g.hour, coalesce(v.lai, g.lai) AS lai FROM gaps g LEFT JOIN given v USING (site, year, doy, hour))
SELECT site, year, doy, hour, round(CAST(last_value(lai IGNORE NULLS) OVER (PARTITION BY site ORDER BY year, doy, hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(38, 9)), 6)::DOUBLE AS lai FROM filled""")
def _(s, d):
    x = T.table(s, d, "lineitem").groupBy((F.col("l_suppkey") % 3).alias("site"), F.year("l_shipdate").alias("year"), F.dayofyear("l_shipdate").alias("doy")).agg(F.avg("l_quantity").alias("lai"))
    gaps = x.withColumn("lai", F.when((F.col("year") % 3 == 0) & (F.col("doy") % 2 == 0), F.lit(None)).otherwise(F.col("lai"))).withColumn("hour", F.lit(0.0))
    return r_all(G.fill_years(gaps, "lai"))


@add("g10_site_settings", f"""
SELECT s.site, v.key, v.value FROM sites s CROSS JOIN LATERAL (VALUES ('lon', CAST(s.lon AS VARCHAR)), ('lat', CAST(s.lat AS VARCHAR)), ('plant_functional_type_id', CAST(([1, 2, 3, 4, 4, 5, 5, 6, 7, 7, 8, 8])[s.site % 12 + 1] AS VARCHAR))) v(key, value)""", "sites")
def _(s, d):
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("site") % 12 + 1).cast("int"))
    return G.site_settings(T.sites(s, d).withColumn("PFT", code), J.PLANT_TYPES, ["lon", "lat"])


@add("g12_filter_site_list", "SELECT site, lon, lat, 1901 AS start FROM sites WHERE site IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)", "sites")
def _(s, d):
    a = T.table(s, d, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("site"))
    b = T.table(s, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("site"))
    return G.filter_site_list(T.sites(s, d), a, b)


@add("g13_grid_monthly_series", """
SELECT CAST(l_suppkey % 36 * 10 - 175 AS DOUBLE) AS lon, CAST(l_suppkey % 18 * 10 - 85 AS DOUBLE) AS lat, CAST(DATE '1981-01-01' + to_months(CAST(l_partkey % 24 AS INTEGER)) AS DATE) AS date,
  round(CAST(avg(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS DECIMAL(38, 9)), 6)::DOUBLE AS "A", round(CAST(avg(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS DECIMAL(38, 9)), 6)::DOUBLE AS "N", round(CAST(avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS DECIMAL(38, 9)), 6)::DOUBLE AS "R" FROM lineitem GROUP BY 1, 2, 3""")
def _(s, d):
    x = T.table(s, d, "lineitem").groupBy((F.col("l_suppkey") % 36 * 10 - 175).cast("double").alias("lon"), (F.col("l_suppkey") % 18 * 10 - 85).cast("double").alias("lat"), F.col("l_returnflag").alias("variable"), (F.col("l_partkey") % 24).alias("step")).agg(F.avg("l_quantity").alias("value"))
    return r_all(G.grid_monthly_series(x, ["A", "N", "R"]))


# D: downscaling

LINE = """b AS (SELECT year, month, value, coalesce(lag(value) OVER w, last_value(value) OVER (PARTITION BY year ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS p,
  coalesce(lead(value) OVER w, first_value(value) OVER (PARTITION BY year ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS n,
  CAST(day(last_day(make_date(2001, month, 1))) AS INTEGER) AS days FROM monthly WINDOW w AS (PARTITION BY year ORDER BY month)),
l AS (SELECT *, CAST(i AS INTEGER) AS i2, (p + value) / 2 AS f, (value + n) / 2 AS e, value - (((p + value) / 2 - value) + ((value + n) / 2 - value)) / 2 AS mid FROM b, range(0, 31) t(i) WHERE i < days),
v AS (SELECT *, CASE WHEN i2 + 0.5::DOUBLE < days / 2.0::DOUBLE THEN f + (mid - f) / (days / 2.0::DOUBLE) * (i2 + 0.5::DOUBLE) ELSE mid + (e - mid) / (days / 2.0::DOUBLE) * (i2 + 0.5::DOUBLE - days / 2.0::DOUBLE) END AS x, days % 2 = 1 AND i2 = days // 2 AS centre FROM l),
o AS (SELECT *, CASE WHEN centre THEN days * value - sum(CASE WHEN centre THEN 0 ELSE x END) OVER (PARTITION BY year, month) ELSE x END AS y FROM v)"""


@add("d01_monthly_to_daily", f"WITH {LINE} SELECT year, month, CAST(dayofyear(make_date(2001, month, 1)) + i2 AS INTEGER) AS doy, round(CAST(y AS DECIMAL(38, 7)), 4)::DOUBLE AS value FROM o", "monthly")
def _(s, d):
    return r_all(D.monthly_to_daily(T.monthly(s, d), []), 4)


@add("d01_monthly_to_daily_clamped", f"""WITH {LINE},
lo AS (SELECT *, CASE WHEN y < 51000 THEN 51000.0 ELSE y - (y - 51000) * (CASE WHEN sum(greatest(y - 51000, 0)) OVER w > 0 THEN sum(greatest(51000 - y, 0)) OVER w / sum(greatest(y - 51000, 0)) OVER w ELSE 0 END) END AS z FROM o WINDOW w AS (PARTITION BY year, month))
SELECT year, month, CAST(dayofyear(make_date(2001, month, 1)) + i2 AS INTEGER) AS doy, round(CAST(greatest(z, 51000.0) AS DECIMAL(38, 7)), 4)::DOUBLE AS value FROM lo""", "monthly")
def _(s, d):
    # the minimum is below every monthly mean only where the data allow it: months whose mean is lower keep the minimum
    return r_all(D.monthly_to_daily(T.monthly(s, d), [], low=51000.0), 4)


@add("d01_monthly_to_daily_below", f"""WITH {LINE},
hi AS (SELECT *, CASE WHEN y >= 51500 THEN 51500.0 ELSE least(51500.0, y + (51500 - y) * (CASE WHEN sum(greatest(51500 - y, 0)) OVER w > 0 THEN sum(greatest(y - 51500, 0)) OVER w / sum(greatest(51500 - y, 0)) OVER w ELSE 0 END)) END AS z FROM o WINDOW w AS (PARTITION BY year, month))
SELECT year, month, CAST(dayofyear(make_date(2001, month, 1)) + i2 AS INTEGER) AS doy, round(CAST(z AS DECIMAL(38, 7)), 4)::DOUBLE AS value FROM hi""", "monthly")
def _(s, d):
    # as for the minimum: months whose mean is higher keep the maximum
    return r_all(D.monthly_to_daily(T.monthly(s, d), [], high=51500.0), 4)


@add("d02_longwave_bounds", "SELECT year, month, round(CAST(value AS DECIMAL(38, 7)), 4)::DOUBLE AS lw, round(CAST(value * 0.8 AS DECIMAL(38, 7)), 4)::DOUBLE AS lw_min, round(CAST(value * 1.2 AS DECIMAL(38, 7)), 4)::DOUBLE AS lw_max FROM monthly", "monthly")
def _(s, d):
    return r_all(D.longwave_bounds(T.monthly(s, d).withColumnRenamed("value", "lw")), 4)


DAYS = "days AS (SELECT site, lon, lat, CAST(doy AS INTEGER) AS doy, 10 + site % 7 AS t_min, 18 + site % 11 AS t_max, 4.0::DOUBLE + site % 5 AS par_day FROM sites CROSS JOIN (SELECT unnest([1, 80, 172, 266, 355]) AS doy))"
SUN = f"""{DAYS}, sl AS (SELECT *, CAST(k AS INTEGER) - 1 AS slot, k / 2.0::DOUBLE AS hour, -23.4::DOUBLE * (pi() / 180) * cos(2 * pi() * (doy + 10) / 365.0::DOUBLE) AS dec, 2 * pi() * (doy - 1) / 365.0::DOUBLE AS gam, lat * pi() / 180 AS phi FROM days, range(1, 49) t(k)),
noon AS (SELECT *, 12.0::DOUBLE + (4.0::DOUBLE * (round(lon / 15.0::DOUBLE) * 15 - lon) - (0.017::DOUBLE + 0.4281::DOUBLE * cos(gam) - 7.351::DOUBLE * sin(gam) - 3.349::DOUBLE * cos(2 * gam) - 9.731::DOUBLE * sin(gam))) / 60.0::DOUBLE AS t0 FROM sl),
sun AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, sin(phi) * sin(dec) + cos(phi) * cos(dec) * cos(pi() * (hour - t0) / 12))) AS cz FROM noon)"""
PAR = f"""{SUN}, sky AS (SELECT *, sum(cz * 1362.0::DOUBLE * (1 + 0.033::DOUBLE * cos(doy / 365.0::DOUBLE * 2 * pi())) * 1800 * 1e-6) OVER w AS s0, CASE WHEN cz > 0 AND acos(cz) < 80 * pi() / 180 THEN cz * pow(0.76::DOUBLE, 1 / cz) ELSE 0 END AS bm, sum(cz) OVER w AS sdf FROM sun WINDOW w AS (PARTITION BY site, doy)),
fr AS (SELECT *, sum(bm) OVER (PARTITION BY site, doy) AS sbm, CASE WHEN s0 = 0 THEN 0.23::DOUBLE WHEN par_day / 0.5::DOUBLE / s0 < 0.07 THEN 1.0 WHEN par_day / 0.5::DOUBLE / s0 < 0.36 THEN 1 - 2.3::DOUBLE * pow(par_day / 0.5::DOUBLE / s0 - 0.07::DOUBLE, 2) WHEN par_day / 0.5::DOUBLE / s0 < 0.75 THEN 1.33::DOUBLE - 1.46::DOUBLE * (par_day / 0.5::DOUBLE / s0) ELSE 0.23 END AS df FROM sky),
par AS (SELECT *, CASE WHEN sbm > 0 THEN par_day * (1 - df) * bm / sbm ELSE 0 END + CASE WHEN sdf > 0 THEN par_day * df * cz / sdf ELSE 0 END AS par FROM fr)"""
TEMP = f"""{SUN}, dl0 AS (SELECT *, -sin(23.5::DOUBLE * pi() / 180) * cos(2 * pi() * (doy + 10.0::DOUBLE) / 365.0::DOUBLE) AS sd FROM sun),
dl1 AS (SELECT *, sin(phi) * sd / (cos(phi) * cos(asin(sd))) AS ab FROM dl0),
dl AS (SELECT *, CASE WHEN ab < -1 THEN 0.0::DOUBLE WHEN ab > 1 THEN 24.0::DOUBLE ELSE 12 * (1 + 2 / pi() * asin(least(1, greatest(-1, ab)))) END AS len FROM dl1),
tm AS (SELECT *, 12 - len / 2 - 0.17::DOUBLE AS rise, 12 + len / 2 AS down FROM dl),
ts AS (SELECT *, (t_max - t_min) * sin(pi() * (down - rise - 0.17::DOUBLE) / (len + 3.72::DOUBLE)) + t_min AS tset FROM tm),
temp AS (SELECT *, CASE WHEN hour >= rise AND hour <= down THEN (t_max - t_min) * sin(pi() * (hour - rise - 0.17::DOUBLE) / (len + 3.72::DOUBLE)) + t_min
  ELSE (t_min - (tset - t_min) / (exp(2.2::DOUBLE) - 1)) + (tset - t_min - (tset - t_min) / (exp(2.2::DOUBLE) - 1)) * exp(-2.2::DOUBLE * (CASE WHEN hour > down THEN hour - down ELSE 24 + hour - down END) / (24 - len - 0.17::DOUBLE)) END AS t FROM ts)"""


def days(s, d):
    doys = s.createDataFrame([(x,) for x in (1, 80, 172, 266, 355)], "doy INT")
    k = F.col("site")
    return T.sites(s, d).crossJoin(F.broadcast(doys)).withColumns({"t_min": (10 + k % 7).cast("double"), "t_max": (18 + k % 11).cast("double"), "par_day": 4.0 + k % 5})


def sun(s, d):
    return days(s, d).withColumn("cz", D.solar_geometry(F.col("lat"), F.col("lon"), F.col("doy")))


def par(s, d):
    return D.diurnal_par(sun(s, d), ["site", "doy"])


def temperature(s, d):
    return days(s, d).withColumn("length", S.day_length(F.col("lat"), F.col("doy"))).withColumn("t", D.diurnal_temperature(F.col("t_min"), F.col("t_max"), F.col("length")))


@add("d03_solar_geometry", f"WITH {SUN} SELECT site, doy, slot, round(CAST(cz AS DECIMAL(38, 9)), 6)::DOUBLE AS cz FROM sun", "sites")
def _(s, d):
    return r_all(D.explode_slots(sun(s, d), ["cz"], ["site", "doy"]))


@add("d04_diurnal_par", f"WITH {PAR} SELECT site, doy, slot, round(CAST(par AS DECIMAL(38, 9)), 6)::DOUBLE AS par FROM par", "sites")
def _(s, d):
    return r_all(par(s, d).drop("par_mean"))


@add("d05_diurnal_temperature", f"WITH {TEMP} SELECT site, doy, slot, round(CAST(t AS DECIMAL(38, 9)), 6)::DOUBLE AS t FROM temp", "sites")
def _(s, d):
    return r_all(D.explode_slots(temperature(s, d), ["t"], ["site", "doy"]))


@add("d06_humidity", f"""WITH {TEMP}, rh AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.263::DOUBLE * 101300 * 0.007::DOUBLE / exp(17.67::DOUBLE * t_mean / (t_mean + 243.5::DOUBLE)) / 100)) AS rh FROM (SELECT *, (t_min + t_max) / 2.0::DOUBLE AS t_mean FROM temp))
SELECT site, doy, slot, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, rh / 0.263::DOUBLE / 101300 * 100 * exp(17.67::DOUBLE * t / (t + 243.5::DOUBLE)))), 8) AS q, round(0.61078::DOUBLE * exp(17.27::DOUBLE * t / (t + 237.3::DOUBLE)) * (1 - rh), 6) AS vpd FROM rh""", "sites")
def _(s, d):
    x = temperature(s, d).withColumn("rh", S.relative_humidity((F.col("t_min") + F.col("t_max")) / 2, F.lit(101300.0), F.lit(0.007)))
    x = x.withColumns({"q": D.diurnal_humidity(F.col("t"), F.lit(101300.0), F.col("rh")), "vpd": D.diurnal_vpd(F.col("t"), F.col("rh"))})
    out = D.explode_slots(x, ["q", "vpd"], ["site", "doy"])
    return out.withColumns({"q": F.round(F.col("q"), 8), "vpd": F.round(F.col("vpd"), 6)})


@add("d07_diurnal_shortwave", f"WITH {PAR} SELECT site, doy, slot, round(CAST(CASE WHEN avg(par) OVER (PARTITION BY site, doy) > 0.0001 THEN 180.0 * par / avg(par) OVER (PARTITION BY site, doy) ELSE 0 END AS DECIMAL(38, 8)), 5)::DOUBLE AS sw FROM par", "sites")
def _(s, d):
    return r_all(par(s, d).select("site", "doy", "slot", D.diurnal_shortwave(F.lit(180.0), F.col("par"), F.col("par_mean")).alias("sw")), 5)


@add("d08_diurnal_longwave", f"""WITH {TEMP}, raw AS (SELECT *, CASE WHEN max(t) OVER w - min(t) OVER w <= 1e-6 THEN 300 ELSE (360.0 - 240) / (max(t) OVER w - min(t) OVER w) * t - (360.0 * min(t) OVER w - 240.0 * max(t) OVER w) / (max(t) OVER w - min(t) OVER w) END AS x FROM temp WINDOW w AS (PARTITION BY site, doy))
SELECT site, doy, slot, round(CAST(CASE WHEN avg(x) OVER (PARTITION BY site, doy) < 0.0001 THEN 0 ELSE x * 300 / avg(x) OVER (PARTITION BY site, doy) END AS DECIMAL(38, 8)), 5)::DOUBLE AS lw FROM raw""", "sites")
def _(s, d):
    return r_all(D.diurnal_longwave(temperature(s, d), ["site", "doy"], F.lit(240.0), F.lit(360.0), F.lit(300.0)), 5)


# X: designs


X01 = ", ".join(f"(row_number() OVER (ORDER BY {DIGITS.format(f"'7|{c}|' || fid")}, fid) - 1 + {DIGITS.format(f"'8|{c}|' || fid")} / 4503599627370496.0::DOUBLE) / count(*) OVER () AS {c}" for c in ("k_xylem", "g0", "g1"))


@add("x01_latin_hypercube", f"SELECT fid AS id, {X01} FROM params", "params")
def _(s, d):
    return X.latin_hypercube(T.params(s, d).select(F.col("fid").alias("id")), ["k_xylem", "g0", "g1"], 7)


@add("x02_rescale", "SELECT fid, round(CAST(0.1 + size / 50.0::DOUBLE * 0.4 AS DECIMAL(38, 9)), 6)::DOUBLE AS plain, round(CAST(16.0 + size / 50.0::DOUBLE * 8.0 AS DECIMAL(38, 9)), 6)::DOUBLE AS around_mean FROM params", "params")
def _(s, d):
    u = F.col("size") / 50.0
    return r_all(T.params(s, d).select("fid", X.rescale(u, 0.1, 0.5).alias("plain"), X.rescale_mean(u, 20.0, 20.0).alias("around_mean")))


@add("x03_rescale_log", "SELECT fid, round(CAST(pow(10.0, -3 + size / 50.0::DOUBLE * 5) AS DECIMAL(38, 9)), 6)::DOUBLE AS x FROM params", "params")
def _(s, d):
    return r_all(T.params(s, d).select("fid", X.rescale_log(F.col("size") / 50.0, -3.0, 2.0).alias("x")))


@add("x04_one_at_a_time", "SELECT CAST(i AS INTEGER) AS fid, 'price' AS parameter, round(CAST(lo + i * ((hi - lo) / 24) AS DECIMAL(38, 9)), 6)::DOUBLE AS value FROM range(0, 25) t(i), (SELECT min(price) AS lo, max(price) AS hi FROM params)", "params")
def _(s, d):
    lo, hi = T.params(s, d).agg(F.min("price"), F.max("price")).first()
    return r_all(X.one_at_a_time(s, "price", lo, hi, 25))


@add("x05_soil_closure", "SELECT l_orderkey, l_linenumber, l_discount + 0.2 AS silt, l_tax + 0.3 AS sand, round(1.0 - (l_discount + 0.2) - (l_tax + 0.3), 6) AS clay FROM lineitem")
def _(s, d):
    x = T.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") + 0.2).alias("silt"), (F.col("l_tax") + 0.3).alias("sand"))
    return X.soil_closure(x).withColumn("clay", F.round(F.col("clay"), 6))


@add("x06_tile_categories", "SELECT p.fid AS run, p.size, o.soil, CAST(o.k * (SELECT count(*) FROM params) + p.fid AS INTEGER) AS fid FROM params p CROSS JOIN (VALUES (0, 'campbell'), (1, 'saxton'), (2, 'genuchten')) o(k, soil)", "params")
def _(s, d):
    p = T.params(s, d).select(F.col("fid").alias("run"), "size")
    return X.tile_categories(p, ["campbell", "saxton", "genuchten"], "soil", F.col("run"), p.count())


@add("x07_rerun_matrix", "SELECT fid, model, pathway, model || '/' || pathway || '/' || fid AS folder FROM params CROSS JOIN (VALUES ('gfdl'), ('ipsl'), ('ukesm')) m(model) CROSS JOIN (VALUES ('ssp126'), ('ssp370'), ('ssp585')) p(pathway) WHERE price > 1500", "params")
def _(s, d):
    return X.rerun_matrix(T.params(s, d).filter("price > 1500"), ["gfdl", "ipsl", "ukesm"], ["ssp126", "ssp370", "ssp585"])
