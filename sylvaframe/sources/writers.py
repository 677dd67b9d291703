"""Sinks: ordinary Spark writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_scores(scores: DataFrame, path: str, metrics: list[str], eras: list[str], fmt: str = "csv") -> None:
    from ..operators.metrics import score_table

    score_table(scores, metrics, eras).orderBy("fid").write.mode("overwrite").option("header", "true").format(fmt).save(path)


def forcing_lines(df: DataFrame, columns: list[str], units: list[str], site: str = "site", order: tuple[str, ...] = ("year", "doy", "hour")) -> DataFrame:
    """(site, value): space-separated lines, the names first, the units second, then the rows in order. To be written
    by site with ``write_forcing``."""
    rows = df.select(site, F.struct(F.lit(2).alias("part"), *[F.col(c).cast("double").alias(f"o{i}") for i, c in enumerate(order)]).alias("at"), F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("value"))
    heads = df.select(site).distinct()
    empty = [F.lit(None).cast("double").alias(f"o{i}") for i in range(len(order))]
    for part, line in enumerate((columns, units)):
        rows = rows.unionByName(heads.select(site, F.struct(F.lit(part).alias("part"), *empty).alias("at"), F.lit(" ".join(line)).alias("value")))
    return rows


def write_forcing(df: DataFrame, path: str, columns: list[str], units: list[str], site: str = "site") -> None:
    """A folder for each site with one text in order."""
    lines = forcing_lines(df, columns, units, site)
    lines.repartition(F.col(site)).sortWithinPartitions(site, "at").select(site, "value").write.mode("overwrite").partitionBy(site).text(path)


def write_obs(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_id_list(df: DataFrame, path: str, key: str = "fid") -> None:
    df.select(key).write.mode("overwrite").option("header", "true").csv(path)
