"""S, C, R: sources, catalog, streams. Readers of text formats read what Spark has written from the tables, in a scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.ensemble import progress
from ..operators.reduce import resample_30min
from ..sources import catalog as C
from ..sources import readers as R
from ..sources import store
from ..sources import testbed as T
from ..sources import writers as O
from ..streaming import jobs
from ..sources.store import scratch
from .book import Book, r_all

book = Book()
add = book.add


def wide_output(s, d) -> DataFrame:
    return T.table(s, d, "lineitem").select((F.col("l_suppkey") % 10).cast("int").alias("fid"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("gpp"), F.col("l_discount").alias("npp"), F.col("l_tax").alias("qle"))


@add("s01_run_catalog", "SELECT CAST(site AS VARCHAR) AS fid, v.* FROM sites CROSS JOIN (VALUES ('Q_ASSIMI', 'fluxnetdata', 'timestep'), ('VEG', 'transient', 'daily'), ('SPQ', 'spinup', 'yearly')) v(cat, sim_type, time_res)", "sites")
def _(s, d):
    # one small file for each supplier and kind of output, as a model would leave it; the run is the folder above
    root = scratch(s)
    kinds = s.createDataFrame([("Q_ASSIMI_fluxnetdata_timestep.txt",), ("VEG_transient_daily.txt",), ("SPQ_spinup_yearly.txt",)], "f STRING")

    def leave(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for site, f in zip(batch.column("site").to_pylist(), batch.column("f").to_pylist()):
                store.create_dir(f"{base}/{site}", recursive=True)
                with store.open_output_stream(f"{base}/{site}/{f}") as out:
                    out.write(f"{site}\n".encode())
            yield batch

    T.sites(s, d).crossJoin(F.broadcast(kinds)).select("site", "f").mapInArrow(leave, "site long, f string").count()
    return R.run_catalog(s, root).drop("path", "length")


@add("s03_read_model", "SELECT fid, o, n, v.variable, v.value FROM (SELECT CAST(l_suppkey % 10 AS INTEGER) AS fid, l_orderkey AS o, l_linenumber AS n, l_quantity AS gpp, l_discount AS npp FROM lineitem) CROSS JOIN LATERAL (VALUES ('gpp', gpp), ('npp', npp)) v(variable, value)")
def _(s, d):
    return R.read_model(wide_output(s, d), ["fid", "o", "n"], ["gpp", "npp"])


STORED = "long AS (SELECT CAST(l_suppkey % 10 AS INTEGER) AS fid, CASE WHEN l_suppkey % 3 = 0 THEN 'static' ELSE 'transient' END AS sim_type, 'daily' AS time_res, 'VEG' AS cat, v.variable, CAST(l_linenumber AS INTEGER) AS layer, l_shipdate AS ts, v.value FROM lineitem CROSS JOIN LATERAL (VALUES ('gpp', l_quantity), ('npp', l_discount), ('qle', l_tax)) v(variable, value))"


@add("s03_stored_model", f"WITH {STORED} SELECT * FROM long WHERE variable = 'gpp' AND sim_type = 'transient' AND fid IN (3, 4, 5) AND ts >= TIMESTAMP '1996-03-01' AND ts < TIMESTAMP '1998-01-01'")
def _(s, d):
    # all variables are written; the rows of one of them, of three runs and of a period are read back
    wide = T.table(s, d, "lineitem").select((F.col("l_suppkey") % 10).cast("int").alias("fid"), F.when(F.col("l_suppkey") % 3 == 0, "static").otherwise("transient").alias("sim_type"), F.lit("daily").alias("time_res"), F.lit("VEG").alias("cat"), F.col("l_linenumber").cast("int").alias("layer"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("gpp"), F.col("l_discount").alias("npp"), F.col("l_tax").alias("qle"))
    path = scratch(s)
    store.write_model(R.read_model(wide, ["fid", "sim_type", "time_res", "cat", "layer", "ts"], ["gpp", "npp", "qle"]), path)
    return store.read_model(s, path, ["gpp"], "transient", fids=[3, 4, 5], begin="1996-03-01", until="1998-01-01")


@add("s04_read_layered", "SELECT fid, layer, round(CAST(sum(value) AS DECIMAL(38, 7)), 4)::DOUBLE AS total, count(*) AS n FROM (SELECT fid, CAST(unnest(range(0, 64)) AS INTEGER) AS layer, CAST(unnest(\"values\") AS DOUBLE) AS value FROM layered) GROUP BY 1, 2", "layered")
def _(s, d):
    long = R.read_layered(T.layered(s, d), ["fid", "step"], "values")
    return r_all(long.groupBy("fid", F.col("layer").cast("int").alias("layer")).agg(F.sum("value").alias("total"), F.count("*").alias("n")), 4)


@add("s05_read_obs", "SELECT date_trunc('second', ts) AS ts, value AS gpp FROM obs WHERE value > 1", "obs")
def _(s, d):
    path = scratch(s)
    T.obs(s, d).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), F.when(F.col("value") > 1, F.col("value").cast("string")).otherwise("NaN").alias("GPP")).write.option("header", "true").csv(path)
    return R.read_obs(s, path, {"GPP": "gpp"}, "time", "yyyy-MM-dd HH:mm:ss")


@add("s06_read_point_obs", "SELECT fid, variable, ts - INTERVAL 30 MINUTE AS ts, value FROM daily WHERE NOT (month(ts) = 2 AND day(ts) = 29)", "daily")
def _(s, d):
    return R.clean_point_obs(T.daily(s, d).withColumns({"lon": F.lit(1.0), "lat": F.lit(2.0)}))


FORCING = ["year", "doy", "hour", "t_air", "rain"]


def forcing(s, d) -> DataFrame:
    rows = T.table(s, d, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("site"), F.year("l_shipdate").alias("year"), F.dayofyear("l_shipdate").alias("doy"))
    return rows.agg(F.max("l_quantity").alias("t_air"), F.max("l_discount").alias("rain")).withColumn("hour", F.lit(0.5))


FORCING_SQL = "SELECT l_suppkey % 4 AS site, CAST(year(l_shipdate) AS DOUBLE) AS year, CAST(dayofyear(l_shipdate) AS DOUBLE) AS doy, 0.5::DOUBLE AS hour, max(l_quantity) AS t_air, max(l_discount) AS rain FROM lineitem GROUP BY 1, 2, 3"


@add("s07_s17_forcing_round_trip", FORCING_SQL)
def _(s, d):
    path = scratch(s)
    O.write_forcing(forcing(s, d), path, FORCING, ["-", "-", "h", "K", "mm"])
    back = R.read_forcing(s, path + "/*", FORCING)
    return back.select(F.regexp_extract("path", r"site=(\d+)/", 1).cast("long").alias("site"), *FORCING)


@add("s08_read_weekly_text", "SELECT CAST(event_id AS BIGINT) AS step, value, CAST(DATE '1901-01-01' + to_days(CAST(event_id * 7 AS INTEGER)) AS DATE) AS date, CAST(year(DATE '1901-01-01' + to_days(CAST(event_id * 7 AS INTEGER))) AS INTEGER) AS year, CAST(month(DATE '1901-01-01' + to_days(CAST(event_id * 7 AS INTEGER))) AS INTEGER) AS month FROM events")
def _(s, d):
    path = scratch(s)
    T.table(s, d, "events").select(F.concat_ws("  ", F.col("event_id").cast("string"), F.col("value").cast("string")).alias("value")).write.text(path)
    return R.read_weekly_text(s, path, ["value"], 1901).select("step", "value", "date", "year", "month")


@add("s09_read_sites", "SELECT site, lon, CASE WHEN site % 5 = 0 THEN NULL ELSE lat END AS lat FROM sites", "sites")
def _(s, d):
    return R.read_sites(T.sites(s, d).withColumn("lat", F.when(F.col("site") % 5 == 0, -9999.0).otherwise(F.col("lat"))))


@add("s10_read_annual_series", "SELECT year, round(CAST(value AS DECIMAL(38, 7)), 4)::DOUBLE AS value FROM annual", "annual")
def _(s, d):
    return r_all(R.mid_year(T.annual(s, d).withColumn("year", F.col("year") + 0.5)), 4)


@add("s11_read_monthly_forcing", "SELECT event_id AS i, value AS tmp, CAST(1901 + event_id // 12 AS INTEGER) AS year, CAST(event_id % 12 + 1 AS INTEGER) AS month FROM events")
def _(s, d):
    path = scratch(s)
    T.table(s, d, "events").select(F.col("event_id").alias("i"), F.col("value").alias("tmp"), F.col("event_type").alias("other")).write.option("header", "true").csv(path)
    wide = s.read.option("header", "true").csv(path).select(F.col("i").cast("long").alias("i"), F.col("tmp").cast("double").alias("tmp"))
    return R.monthly_from_index(wide, 1901)


def texts(s, d) -> DataFrame:
    """A configuration for each customer, made of its columns."""
    c = T.table(s, d, "customer")
    lines = F.concat_ws("\n", F.lit("! made from a table"), F.lit("&vegetation_ctl"), F.lit("  ! a comment"), F.concat(F.lit("  scheme=\""), "c_mktsegment", F.lit("\" ! trailing")), F.concat(F.lit("  type_id="), F.col("c_nationkey").cast("string")),
                        F.concat(F.lit("  flag_fire=."), F.when(F.col("c_custkey") % 2 == 0, "TRUE").otherwise("FALSE"), F.lit(".")), F.concat(F.lit("  density="), F.col("c_acctbal").cast("decimal(12,2)").cast("string")), F.lit("/"), F.lit("&OUTPUT_CTL"), F.concat(F.lit("  name='"), "c_name", F.lit("'")), F.lit("/"))
    return c.select(F.col("c_custkey").cast("int").alias("fid"), lines.alias("text"))


@add("s13_parse_namelists", """
SELECT CAST(c_custkey AS INTEGER) AS fid, v.* FROM customer CROSS JOIN LATERAL (VALUES ('VEGETATION_CTL', 'scheme', 'string', c_mktsegment), ('VEGETATION_CTL', 'type_id', 'int', CAST(c_nationkey AS VARCHAR)),
  ('VEGETATION_CTL', 'flag_fire', 'bool', CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END), ('VEGETATION_CTL', 'density', 'float', CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS VARCHAR)), ('OUTPUT_CTL', 'name', 'string', c_name)) v("group", key, type, value)""")
def _(s, d):
    return R.parse_namelists(texts(s, d))


@add("s12_read_run_info", "SELECT CAST(c_custkey AS INTEGER) AS fid, 'c' || c_custkey AS commit, 'main' AS branch, 'unknown' AS status, c_name AS site, c_mktsegment AS user, 'unknown' AS date, 'unknown' AS plant_type FROM customer")
def _(s, d):
    text = F.concat_ws("\n", F.concat(F.lit("Commit: c"), F.col("c_custkey").cast("string")), F.lit("branch = main"), F.concat(F.lit("Site: "), "c_name"), F.concat(F.lit("user:  "), "c_mktsegment", F.lit("  ")))
    return R.run_info(T.table(s, d, "customer").select(F.col("c_custkey").cast("int").alias("fid"), text.alias("text")))


@add("s14_parse_type_table", "SELECT CAST(c_custkey AS INTEGER) AS fid, 'beta' AS key, CAST(i + 1 AS INTEGER) AS pft, CAST(CAST(c_acctbal + i AS DECIMAL(12, 2)) AS DOUBLE) AS value FROM customer, range(0, 14) t(i)")
def _(s, d):
    c = T.table(s, d, "customer")
    values = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(13)), lambda i: (F.col("c_acctbal") + i).cast("decimal(12,2)").cast("string")), "  ")
    text = F.concat_ws("\n", F.lit("# a comment"), F.concat(F.lit("beta "), values), F.lit("short 1 2 3"), F.lit(""))
    return R.parse_type_table(c.select(F.col("c_custkey").cast("int").alias("fid"), text.alias("text")))[0]


@add("s18_write_obs", "SELECT variable, ts, value FROM obs WHERE value > 5", "obs")
def _(s, d):
    path = scratch(s)
    O.write_obs(T.obs(s, d).filter("value > 5"), path)
    return s.read.parquet(path)


@add("s19_write_id_list", "SELECT fid FROM scores WHERE disc <= 0.048", "scores")
def _(s, d):
    path = scratch(s)
    O.write_id_list(T.scores(s, d).filter("disc <= 0.048"), path)
    return s.read.schema("fid BIGINT").option("header", "true").csv(path)


# C: catalog


def variables(s, d) -> DataFrame:
    return T.table(s, d, "part").select(F.concat(F.lit("v"), F.col("p_size")).alias("variable"), F.when(F.col("p_size") % 2 == 0, "mm").otherwise("K").alias("unit"), F.when(F.col("p_size") > 25, 2).otherwise(1).alias("ndim"), F.element_at(F.array(F.lit("static"), F.lit("transient")), (F.col("p_partkey") % 2 + 1).cast("int")).alias("sim_type"), F.when(F.col("p_size") < 40, "VEG").otherwise(F.col("p_brand")).alias("cat"))


VARIABLES = "v AS (SELECT 'v' || p_size AS variable, CASE WHEN p_size % 2 = 0 THEN 'mm' ELSE 'K' END AS unit, CASE WHEN p_size > 25 THEN 2 ELSE 1 END AS ndim, (['static', 'transient'])[p_partkey % 2 + 1] AS sim_type, CASE WHEN p_size < 40 THEN 'VEG' ELSE p_brand END AS cat FROM part)"
WANTED = "w AS (SELECT DISTINCT 'v' || (n_nationkey * 3) AS variable, (['static', 'transient'])[n_nationkey % 2 + 1] AS sim_type FROM nation)"


def wanted(s, d) -> DataFrame:
    n = F.col("n_nationkey")
    return T.table(s, d, "nation").select(F.concat(F.lit("v"), n * 3).alias("variable"), F.element_at(F.array(F.lit("static"), F.lit("transient")), (n % 2 + 1).cast("int")).alias("sim_type")).distinct()


@add("c01_list_variables", f"WITH {VARIABLES} SELECT DISTINCT variable, unit, ndim FROM v")
def _(s, d):
    return C.list_variables(variables(s, d))


@add("c03_resolve_variable", f"WITH {VARIABLES}, {WANTED}, r AS (SELECT w.variable, w.sim_type, count(DISTINCT cat) AS n, min(cat) AS cat FROM w LEFT JOIN v ON w.variable = v.variable AND w.sim_type = v.sim_type GROUP BY 1, 2) SELECT variable, sim_type, CASE WHEN n = 1 THEN cat END AS cat, CASE WHEN n = 1 THEN 'ok' WHEN n = 0 THEN 'not found' ELSE 'ambiguous' END AS status FROM r")
def _(s, d):
    return C.resolve_variable(variables(s, d), wanted(s, d))


CHECKED = f"{VARIABLES}, t AS (SELECT n_name AS pair, CASE n_nationkey % 2 WHEN 0 THEN 'model' ELSE 'obs' END AS side, 'v' || (n_nationkey * k) AS variable FROM nation, (VALUES (2), (3)) m(k)), h AS (SELECT DISTINCT CASE sim_type WHEN 'static' THEN 'model' ELSE 'obs' END AS side, variable FROM v), c AS (SELECT t.pair, t.side, t.variable, h.variable IS NOT NULL AS found FROM t LEFT JOIN h ON t.side = h.side AND t.variable = h.variable)"


def checked(s, d) -> DataFrame:
    n = F.col("n_nationkey")
    terms = T.table(s, d, "nation").select(F.col("n_name").alias("pair"), F.when(n % 2 == 0, "model").otherwise("obs").alias("side"), F.explode(F.array(F.concat(F.lit("v"), n * 2), F.concat(F.lit("v"), n * 3))).alias("variable"))
    return C.check_variables(terms, variables(s, d).select(F.when(F.col("sim_type") == "static", "model").otherwise("obs").alias("side"), "variable"))


@add("c04_check_variables", f"WITH {CHECKED} SELECT pair, side, variable, found FROM c")
def _(s, d):
    return checked(s, d)


@add("c05_reduce_available", f"WITH {CHECKED} SELECT pair FROM c GROUP BY 1 HAVING bool_and(found)")
def _(s, d):
    return C.reduce_available(checked(s, d))


@add("c06_missing_categories", f"WITH {VARIABLES}, q AS (SELECT r_name AS cat FROM region UNION ALL SELECT 'VEG' UNION ALL SELECT DISTINCT p_brand FROM part WHERE p_size = 50) SELECT cat, cat IN (SELECT cat FROM v) AS available FROM q")
def _(s, d):
    q = T.table(s, d, "region").select(F.col("r_name").alias("cat")).unionByName(s.createDataFrame([("VEG",)], "cat STRING")).unionByName(T.table(s, d, "part").filter("p_size = 50").select(F.col("p_brand").alias("cat")).distinct())
    return C.missing_categories(q, variables(s, d))


# R: streams, run to their end over what is there


def event_stream(s, d) -> DataFrame:
    schema = T.table(s, d, "events").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@add("r01_stream_scores", """
WITH o AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS bin, avg(value) AS o FROM obs GROUP BY 1),
ends AS (SELECT n_nationkey AS fid, TIMESTAMP '2024-01-12' + INTERVAL 2 DAY * n_nationkey AS "end" FROM nation WHERE n_nationkey < 6),
x AS (SELECT m.fid, m.value - o AS e FROM (SELECT fid, ts, value, time_bucket(INTERVAL 30 MINUTE, ts) AS bin FROM model WHERE variable = 'click') m JOIN o USING (bin) JOIN ends ON ends.fid = m.fid AND m.ts <= ends."end")
SELECT fid, count(*) AS n, round(CAST(sqrt(sum(e * e) / count(*)) AS DECIMAL(38, 9)), 6)::DOUBLE AS rmse, sqrt(sum(e * e) / count(*)) > 75 AS rejected, 'end' AS closed_by FROM x GROUP BY 1""", "model obs")
def _(s, d):
    # six runs end in the time of the stream; the other two go on, so there is no verdict on them yet
    rows = event_stream(s, d).filter("event_type = 'click'").select((F.col("user_id") % 8).cast("int").alias("fid"), "ts", "value")
    o = resample_30min(T.obs(s, d), []).withColumnRenamed("value", "o")
    ends = T.table(s, d, "nation").filter("n_nationkey < 6").select(F.col("n_nationkey").cast("int").alias("fid"), F.expr("TIMESTAMP_NTZ '2024-01-12' + make_interval(0, 0, 0, 2 * n_nationkey)").alias("end"))
    return r_all(jobs.drain(jobs.stream_scores(rows, o, 75.0, ends), ["fid"], scratch(s), scratch(s)))


@add("r02_stream_monitor", "SELECT fid, variable, date_trunc('day', ts)::TIMESTAMP AS bucket, round(CAST(avg(value) AS DECIMAL(38, 9)), 6)::DOUBLE AS mean, count(*) AS n, max(ts) AS latest FROM model GROUP BY 1, 2, 3", "model")
def _(s, d):
    rows = event_stream(s, d).filter(F.col("event_type").isin(*T.MODEL_TYPES)).select((F.col("user_id") % 8).cast("int").alias("fid"), F.col("event_type").alias("variable"), "ts", "value")
    out = jobs.drain(jobs.stream_monitor(rows, "day"), ["fid", "variable", "bucket"], scratch(s), scratch(s))
    return r_all(out).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("bucket", "latest")})


@add("r02_stream_monitor_months", "SELECT fid, variable, date_trunc('month', ts)::TIMESTAMP AS bucket, round(CAST(avg(value) AS DECIMAL(38, 7)), 4)::DOUBLE AS mean, count(*) AS n, max(ts)::TIMESTAMP AS latest FROM daily GROUP BY 1, 2, 3", "daily")
def _(s, d):
    lines = s.readStream.schema(T.table(s, d, "lineitem").schema).option("pathGlobFilter", "lineitem.parquet").parquet(d)
    rows = lines.select((F.col("l_suppkey") % 10).cast("int").alias("fid"), F.col("l_returnflag").alias("variable"), F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("value"))
    out = jobs.drain(jobs.stream_monitor(rows, "month"), ["fid", "variable", "bucket"], scratch(s), scratch(s))
    return r_all(out, 4).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("bucket", "latest")})


@add("r03_stream_progress", "SELECT job, node, count(*) AS done, CAST(sum(CASE WHEN task % 13 <> 0 THEN 0 ELSE 1 END) AS BIGINT) AS failed, round(CAST(sum(duration_s) AS DECIMAL(38, 5)), 2)::DOUBLE AS duration_s, round(CAST(max(epoch(ts)) - min(epoch(ts) - duration_s) AS DECIMAL(38, 5)), 2)::DOUBLE AS elapsed_s FROM run_log GROUP BY 1, 2", "run_log")
def _(s, d):
    schema = T.table(s, d, "orders").schema
    log = s.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(d)
    log = log.select(F.col("o_orderpriority").alias("job"), F.col("o_orderstatus").alias("node"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("duration_s"), F.when(F.col("o_orderkey") % 13 == 0, 1).otherwise(0).alias("rc"))
    return r_all(jobs.drain(jobs.stream_progress(log), ["job", "node"], scratch(s), scratch(s)), 2)
