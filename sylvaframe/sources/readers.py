"""Readers. All of them are Spark scans with given schemas; nothing is opened on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..schema import null_nan

NAME = r"/([^/]+)/(?:output/)?((?:Q_)?[A-Za-z0-9]+)_([a-z]+)_([a-z]+)\.[A-Za-z0-9]+$"


def name_parts(path: Column) -> dict[str, Column]:
    """Run folder, category (a leading ``Q_`` belongs to it), simulation type and time resolution of an output file's path."""
    return {k: F.regexp_extract(path, NAME, i + 1) for i, k in enumerate(("fid", "cat", "sim_type", "time_res"))}


def run_catalog(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, fid, cat, sim_type, time_res) of all output files; their contents are not read."""
    return catalog(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length"))


def catalog(files: DataFrame) -> DataFrame:
    """The catalog of files given by (path, length)."""
    parts = name_parts(F.col("path"))
    return files.filter(F.col("path").rlike(NAME)).select("path", "length", *[c.alias(k) for k, c in parts.items()])


def read_model(wide: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """Chosen variables of wide output as long rows; other columns are not read. NaN becomes NULL."""
    rows = wide.select(*keys, *[F.col(v).cast("double").alias(v) for v in variables]).unpivot(keys, variables, "variable", "value")
    return rows.withColumn("value", null_nan(F.col("value")))


def read_layered(df: DataFrame, keys: list[str], values: str) -> DataFrame:
    return df.select(*keys, F.posexplode(values).alias("layer", "value")).withColumn("value", F.col("value").cast("double"))


def read_obs(spark: SparkSession, path: str, columns: dict[str, str], ts: str, ts_format: str, sep: str = ",") -> DataFrame:
    """Typed CSV: ``columns`` are {name in the file: name here}; rows with a missing value are left out."""
    raw = spark.read.option("header", "true").option("sep", sep).csv(path)
    out = raw.select(F.to_timestamp_ntz(F.col(ts), F.lit(ts_format)).alias("ts"), *[null_nan(F.expr(f"try_cast(`{a}` AS DOUBLE)")).alias(b) for a, b in columns.items()])
    return out.dropna()


def clean_point_obs(df: DataFrame, ts: str = "ts", minutes: int = -30) -> DataFrame:
    """A cube with a single cell: without its coordinates and 29 February, stamps moved to interval starts."""
    return C.drop_leap_days(df.drop("lon", "lat", "longitude", "latitude"), ts).withColumn(ts, C.shift_minutes(F.col(ts), minutes))


def read_forcing(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """White-space text with header and unit rows: the rows that start with a number, columns by position."""
    words = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path")).filter(F.col("value").rlike(r"^\s*[-+.]?\d"))
    return rows.select("path", *[F.element_at(words, i + 1).cast("double").alias(c) for i, c in enumerate(columns)])


def weekly_dates(df: DataFrame, first_year: int, index: str = "step") -> DataFrame:
    """Output without dates: a date for each record, exactly seven days apart."""
    date = F.date_add(F.lit(f"{first_year}-01-01").cast("date"), (F.col(index) * 7).cast("int"))
    return df.withColumns({"date": date, "year": F.year(date), "month": F.month(date), "week": C.week_index(date)})


def read_weekly_text(spark: SparkSession, path: str, columns: list[str], first_year: int) -> DataFrame:
    """White-space text whose first column is the record's index."""
    return weekly_dates(read_forcing(spark, path, ["step", *columns]).withColumn("step", F.col("step").cast("long")), first_year)


def read_sites(raw: DataFrame, key: str = "site") -> DataFrame:
    """A site list: -9999 is NULL; a missing or repeated key is an error, raised when the result is computed."""
    clean = raw.withColumns({c: F.nullif(F.col(c), F.lit(-9999).cast(t)) for c, t in raw.dtypes if t in ("double", "int", "bigint", "float") and c != key})
    bad = clean.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_n", F.when(F.col("_key").isNull() | (F.col("_n") > 1), F.raise_error(F.concat(F.lit("missing or repeated site: "), F.coalesce(F.col("_key").cast("string"), F.lit("null")))).cast("long")).otherwise(F.col("_n")))
    return clean.join(bad, F.col(key).eqNullSafe(F.col("_key"))).filter("_n = 1").drop("_key", "_n")


def read_site_text(spark: SparkSession, path: str) -> DataFrame:
    """White-space text with a header row; all columns as text."""
    raw = spark.read.text(path).withColumn("w", F.split(F.trim("value"), r"\s+"))
    head = raw.filter(F.col("value").startswith("Site-ID")).first()
    rows = raw.filter(~F.col("value").startswith("Site-ID") & (F.trim("value") != ""))
    return rows.select(*[F.element_at("w", i + 1).alias(c) for i, c in enumerate(head.w)])


def mid_year(series: DataFrame, year: str = "year") -> DataFrame:
    """Annual values whose year is written as mid-year (1850.5)."""
    return series.withColumn(year, (F.col(year) - 0.5).cast("int"))


def monthly_from_index(df: DataFrame, start: int, index: str = "i") -> DataFrame:
    """Rows of 12 a year: year and month from the row's index."""
    return df.withColumns({"year": (F.lit(start) + F.floor(F.col(index) / 12)).cast("int"), "month": (F.pmod(F.col(index), F.lit(12)) + 1).cast("int")})


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(fid, text): one row a file, the run's number from its folder."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
    return files.select(F.regexp_extract("_metadata.file_path", r"/(\d+)/[^/]+$", 1).cast("int").alias("fid"), F.col("value").alias("text"))


#: Labels of the lines that a run's information file has.
INFO = {"commit": "commit", "branch": "branch", "status": "status", "site": "site", "user": "user", "date": "date", "plant_type": "pft"}


def run_info(texts: DataFrame) -> DataFrame:
    """(fid, a column for each entry of INFO) from ``label: value`` lines; a missing one is 'unknown'."""
    found = {k: F.regexp_extract("text", rf"(?im)^\s*{label}\s*[:=]\s*(.*?)\s*$", 1) for k, label in INFO.items()}
    return texts.select("fid", *[F.when(c == "", "unknown").otherwise(c).alias(k) for k, c in found.items()])


def numbered_lines(texts: DataFrame) -> DataFrame:
    return texts.select("fid", F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw")).withColumn("raw", F.trim("raw"))


def parse_namelists(texts: DataFrame) -> DataFrame:
    """(fid, group, key, type, value) of ``&GROUP`` / ``key=value`` / ``/`` texts; ``!`` begins a comment."""
    rows = numbered_lines(texts).withColumn("raw", F.trim(F.regexp_replace("raw", r"""!(?=([^"]*"[^"]*")*[^"]*$).*""", "")))
    group = F.when(F.col("raw").startswith("&"), F.upper(F.trim(F.expr("substring(raw, 2)")))).when(F.col("raw") == "/", "")
    rows = rows.withColumn("group", F.last(group, ignorenulls=True).over(W.partitionBy("fid").orderBy("line")))
    pair = r"^([A-Za-z_]\w*)\s*=\s*(.*?)\s*,?$"
    rows = rows.filter(F.col("raw").rlike(pair) & (F.col("group") != ""))
    raw = F.regexp_extract("raw", pair, 2)
    kind = F.when(raw.rlike(r"(?i)^\.(true|false)\.$"), "bool").when(raw.rlike(r"^[-+]?\d+$"), "int").when(raw.rlike(r"(?i)^[-+]?(\d+\.?\d*|\.\d+)([ed][-+]?\d+)?$"), "float").otherwise("string")
    value = F.when(kind == "bool", F.lower(F.regexp_replace(raw, r"\.", ""))).when(kind == "string", F.regexp_replace(raw, r"""^["']|["']$""", "")).otherwise(raw)
    return rows.select("fid", "group", F.regexp_extract("raw", pair, 1).alias("key"), kind.alias("type"), value.alias("value"))


def parse_type_table(texts: DataFrame, width: int = 14) -> tuple[DataFrame, DataFrame]:
    """((fid, key, pft from 1, value), (fid, line, key, width)): the values, and the lines that don't have ``width`` of them."""
    rows = numbered_lines(texts).filter((F.col("raw") != "") & ~F.col("raw").startswith("#"))
    words = F.split(F.regexp_replace("raw", r"\s+#.*$", ""), r"\s+")
    rows = rows.select("fid", "line", words[0].alias("key"), F.slice(words, F.lit(2), F.size(words)).alias("values")).withColumn("width", F.size("values"))
    good = rows.filter(F.col("width") == width).select("fid", "key", F.posexplode("values").alias("i", "value"))
    return good.select("fid", "key", (F.col("i") + 1).alias("pft"), F.expr("try_cast(value AS DOUBLE)").alias("value")), rows.filter(F.col("width") != width).select("fid", "line", "key", "width")
