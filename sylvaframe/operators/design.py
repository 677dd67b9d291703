"""Experiment designs: samples and matrices of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import RANGES, before_ranges


def hashed(seed: int, *parts: Column) -> Column:
    """A number below 2**52 that depends on the seed and the parts only: the first 13 hexadecimal digits of an MD5 digest."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the parts only."""
    return hashed(seed, *parts).cast("double") / float(1 << 52)


def latin_hypercube(ids: DataFrame, dims: list[str], seed: int, key: str = "id") -> DataFrame:
    """(key, a column in [0, 1) for each dimension): each of n strata of a dimension holds one point. The points of a dimension are ranked
    by a hash: in ``RANGES`` even ranges of the hash, put one after the other by their counts."""
    long = ids.select(key).withColumn("dim", F.explode(F.array(*map(F.lit, dims)))).withColumn("_h", hashed(seed, F.col("dim"), F.col(key)))
    long = long.withColumn("_range", F.floor(F.col("_h") / float(1 << 52) * RANGES))
    counts = long.groupBy("dim", "_range").agg(F.count(F.lit(1)).alias("_n"))
    ranges = before_ranges(counts, "_n", ["dim"]).join(counts.groupBy("dim").agg(F.sum("_n").alias("_total")), "dim")
    ranges = F.broadcast(ranges)  # RANGES rows a dimension; by the sizes of the files Spark would take the points for the smaller side
    stratum = F.col("_before") + F.row_number().over(W.partitionBy("dim", "_range").orderBy("_h", key)) - 1
    point = (stratum + uniform(seed + 1, F.col("dim"), F.col(key))) / F.col("_total")
    return long.join(ranges, ["dim", "_range"]).withColumn("x", point).groupBy(key).pivot("dim", dims).agg(F.first("x"))


def rescale(x: Column, low: float, high: float) -> Column:
    return low + x * (high - low)


def rescale_mean(x: Column, mean: float, percent: float) -> Column:
    return rescale(x, mean * (100.0 - percent) / 100.0, mean * (100.0 + percent) / 100.0)


def rescale_log(x: Column, low: float, high: float) -> Column:
    """Even in the logarithm: ``low`` and ``high`` are powers of ten's exponents."""
    return F.pow(F.lit(10.0), rescale(x, low, high))


def one_at_a_time(spark: SparkSession, name: str, low: float, high: float, n: int) -> DataFrame:
    step = (high - low) / (n - 1)
    return spark.range(n).select(F.col("id").cast("int").alias("fid"), F.lit(name).alias("parameter"), (low + F.col("id") * step).alias("value"))


def soil_closure(df: DataFrame) -> DataFrame:
    """clay = 1 - silt - sand; a negative one is an error, raised when the result is computed."""
    clay = 1.0 - F.col("silt") - F.col("sand")
    return df.withColumn("clay", F.when(clay >= 0, clay).otherwise(F.raise_error(F.lit("silt and sand exceed 1")).cast("double")))


def tile_categories(sample: DataFrame, options: list[str], name: str, position: Column, size: int) -> DataFrame:
    """The sample once for each option, numbered option by option from 1; run 0 is left for the standard setup."""
    tiles = sample.sparkSession.createDataFrame([(i, o) for i, o in enumerate(options)], f"_o INT, {name} STRING")
    return sample.crossJoin(F.broadcast(tiles)).withColumn("fid", (F.col("_o") * size + position).cast("int")).drop("_o")


def rerun_matrix(runs: DataFrame, models: list[str], pathways: list[str], key: str = "fid") -> DataFrame:
    """Each run with each climate model and pathway, and the folder that they go to."""
    spark = runs.sparkSession
    m = spark.createDataFrame([(x,) for x in models], "model STRING")
    p = spark.createDataFrame([(x,) for x in pathways], "pathway STRING")
    return runs.select(key).crossJoin(F.broadcast(m.crossJoin(p))).withColumn("folder", F.concat_ws("/", "model", "pathway", F.col(key).cast("string")))
