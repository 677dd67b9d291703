"""Canonical tables made from a star schema: events stand for sub-daily output and observations, line items for daily
output of several years, parts for parameters and a grid, suppliers for sites, orders for annual series and a run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL_TYPES = ("click", "purchase", "signup")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, variable, ts, value; one month, irregular stamps."""
    rows = table(spark, sf_dir, "events").filter(F.col("event_type").isin(*MODEL_TYPES))
    return rows.select((F.col("user_id") % 8).cast("int").alias("fid"), F.col("event_type").alias("variable"), "ts", "value")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_type = 'view'").select(F.col("event_type").alias("variable"), "ts", "value")


def obs_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, ts, value: three observed series, two of one kind and one of another."""
    rows = table(spark, sf_dir, "events").filter("event_type IN ('view', 'error')")
    source = F.when(F.col("event_type") == "error", "sap").when(F.col("user_id") % 2 == 0, "flux_a").otherwise("flux_b")
    return rows.select(source.alias("source"), "ts", "value")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, variable, ts, value; daily, several years."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).cast("int").alias("fid"), F.col("l_returnflag").alias("variable"), F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("value"))


def layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, step, values: an array over layers for each step."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("fid"), F.col("vec_id").alias("step"), F.col("embedding").alias("values"))


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fid"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("brand"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("fid"))
    return rows.agg(F.round(F.avg("l_discount"), 9).alias("disc"), F.round(F.avg("l_tax"), 9).alias("tax"), F.round(F.stddev_samp("l_quantity"), 9).alias("qty_sd"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lon, lat, value on a 10-degree grid; some values are NULL."""
    p = F.col("p_partkey")
    lon, lat = (p % 36) * 10 - 175, F.floor(p / 36) % 18 * 10 - 85
    return table(spark, sf_dir, "part").groupBy(lon.cast("double").alias("lon"), lat.cast("double").alias("lat")).agg(F.avg(F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice"))).alias("value"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(s.alias("site"), (s * 73 % 360 - 180).cast("double").alias("lon"), (s * 41 % 180 - 90).cast("double").alias("lat"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """year, month, value for the complete years, which are those with twelve months."""
    months = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")).agg(F.avg("l_extendedprice").alias("value"))
    year = months.groupBy("year").agg(F.collect_list(F.struct("month", "value")).alias("months"))  # twelve at most
    return year.filter(F.size("months") == 12).select("year", F.inline("months"))


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """year, month, value for all years, complete or not."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"))
    return rows.agg(F.avg("l_extendedprice").alias("value"))


def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.avg("o_totalprice").alias("value"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"), F.col("o_orderpriority").alias("job"), F.col("o_orderstatus").alias("node"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("duration_s"))


#: The same tables in SQL, to be put before a query: WITH {model}, ...
SQL = {
    "model": "model AS (SELECT CAST(user_id % 8 AS INTEGER) AS fid, event_type AS variable, ts, value FROM events WHERE event_type IN ('click', 'purchase', 'signup'))",
    "obs": "obs AS (SELECT event_type AS variable, ts, value FROM events WHERE event_type = 'view')",
    "obs_sources": "obs_sources AS (SELECT CASE WHEN event_type = 'error' THEN 'sap' WHEN user_id % 2 = 0 THEN 'flux_a' ELSE 'flux_b' END AS source, ts, value FROM events WHERE event_type IN ('view', 'error'))",
    "daily": "daily AS (SELECT CAST(l_suppkey % 10 AS INTEGER) AS fid, l_returnflag AS variable, l_shipdate AS ts, l_extendedprice AS value FROM lineitem)",
    "layered": "layered AS (SELECT CAST(label AS INTEGER) AS fid, vec_id AS step, embedding AS \"values\" FROM embeddings)",
    "params": "params AS (SELECT p_partkey AS fid, p_size AS size, p_retailprice AS price, p_brand AS brand FROM part)",
    "scores": "scores AS (SELECT l_partkey AS fid, round(avg(l_discount), 9) AS disc, round(avg(l_tax), 9) AS tax, round(stddev_samp(l_quantity), 9) AS qty_sd FROM lineitem GROUP BY 1)",
    "grid": "grid AS (SELECT CAST(p_partkey % 36 * 10 - 175 AS DOUBLE) AS lon, CAST(p_partkey // 36 % 18 * 10 - 85 AS DOUBLE) AS lat, avg(CASE WHEN p_size % 5 <> 0 THEN p_retailprice END) AS value FROM part GROUP BY 1, 2)",
    "sites": "sites AS (SELECT s_suppkey AS site, CAST(s_suppkey * 73 % 360 - 180 AS DOUBLE) AS lon, CAST(s_suppkey * 41 % 180 - 90 AS DOUBLE) AS lat FROM supplier)",
    "months": "months AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2)",
    "monthly": "monthly AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2 QUALIFY count(*) OVER (PARTITION BY year(any_value(l_shipdate))) = 12)",
    "annual": "annual AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, avg(o_totalprice) AS value FROM orders GROUP BY 1)",
    "run_log": "run_log AS (SELECT o_orderkey AS task, o_orderpriority AS job, o_orderstatus AS node, o_orderdate AS ts, o_totalprice AS duration_s FROM orders)",
}
