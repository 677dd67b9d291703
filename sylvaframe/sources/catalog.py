"""What variables there are, and which of the requested ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_variables(variables: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Distinct (variable, unit, ndim); an unknown wanted variable is an error, raised when the result is computed."""
    have = variables.select("variable", "unit", "ndim").distinct()
    if wanted is None:
        return have
    want = variables.sparkSession.createDataFrame([(w,) for w in wanted], "variable STRING")
    out = want.join(have, "variable", "left")
    return out.withColumn("unit", F.when(F.col("ndim").isNull(), F.raise_error(F.concat(F.lit("unknown variable: "), "variable")).cast("string")).otherwise(F.col("unit")))


def resolve_variable(variables: DataFrame, wanted: DataFrame) -> DataFrame:
    """(variable, sim_type, cat, status): the one category that has it, else 'not found' or 'ambiguous'."""
    found = wanted.join(variables.select("variable", "sim_type", "cat").distinct(), ["variable", "sim_type"], "left").groupBy("variable", "sim_type")
    out = found.agg(F.count("cat").alias("n"), F.min("cat").alias("cat"))
    status = F.when(F.col("n") == 1, "ok").when(F.col("n") == 0, "not found").otherwise("ambiguous")
    return out.select("variable", "sim_type", F.when(F.col("n") == 1, F.col("cat")).alias("cat"), status.alias("status"))


def check_variables(terms: DataFrame, variables: DataFrame) -> DataFrame:
    """(pair, side, variable, found) for the terms of pairs; ``variables``: (side, variable)."""
    return terms.join(variables.select("side", "variable").distinct().withColumn("found", F.lit(True)), ["side", "variable"], "left").select("pair", "side", "variable", F.coalesce("found", F.lit(False)).alias("found"))


def reduce_available(checked: DataFrame) -> DataFrame:
    """The pairs whose terms are all there."""
    return checked.groupBy("pair").agg(F.bool_and("found").alias("complete")).filter("complete").select("pair")


def missing_categories(wanted: DataFrame, have: DataFrame, key: str = "cat") -> DataFrame:
    """(cat, available) of what is wanted."""
    names = have.select(key).distinct()
    return wanted.join(names, key, "left_semi").withColumn("available", F.lit(True)).unionByName(wanted.join(names, key, "left_anti").withColumn("available", F.lit(False)))
