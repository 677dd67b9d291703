"""Ranking, selection and statistics of run sets."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sketch
from ..sources.store import scratch
from .design import hashed
from .order import average_ranks, exact_quantiles, numbered
from .slices import bounds


def rank_runs(scores: DataFrame, metric: str, n: int | None = None, key: str = "fid") -> DataFrame:
    """Best (smallest) first; ties by id."""
    out = scores.orderBy(F.col(metric).asc_nulls_last(), key)
    return out.limit(n) if n else out


def best_per_group(df: DataFrame, group: str, metric: str, limits: dict, key: str = "fid") -> DataFrame:
    """Of each group, within the limits, the row with the smallest metric."""
    ok = df.filter(bounds(limits))
    return ok.groupBy(group).agg(F.min_by(key, F.struct(metric, key)).alias(key), F.min(metric).alias(metric))


def evenly_spaced(df: DataFrame, n: int, order: str, key: str = "fid") -> DataFrame:
    """n rows at the positions round(range from 1 to N), ties to even, of the order."""
    total = df.count()
    at = sorted({round(1 + i * (total - 1) / (n - 1)) for i in range(n)}) if n > 1 else [1]
    return numbered(df, order, key).filter(F.col("position").isin(*at))


def nested_sets(df: DataFrame, sets: list[tuple[str, dict]], key: str = "fid") -> DataFrame:
    """(set, fid): each set adds its limits to those of the sets before."""
    total, parts = {}, []
    for name, limits in sets:
        total = total | limits
        parts.append(F.when(bounds(total), F.lit(name)))
    return df.select(F.explode(F.array_compact(F.array(*parts))).alias("set"), key)


def set_summary(df: DataFrame, metric: str, group: str = "set", approx: bool = False) -> DataFrame:
    """mean, the quantiles 0.2, 0.5 and 0.8, and the rows of each set. No set is held in one place: exact quantiles order only the values near them, and ``approx`` takes
    those of a sketch."""
    q = (0.2, 0.5, 0.8)
    if approx:
        found = sketch.quantiles(sketch.sketched(df.select(group, F.col(metric).cast("double").alias("value")), [group]), q).drop("n")
    else:
        found = exact_quantiles(df, q, [group], metric).select(group, "mean", *[F.col("_q")[k].alias(f"q{round(x * 100)}") for k, x in enumerate(q)])
    rows = df.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("n"))
    return found.join(rows, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def pearson_matrix(df: DataFrame, columns: list[str], weak: float = 0.15, strong: float = 0.25) -> DataFrame:
    """(a, b, r, class) of the pairs with at least a weak correlation, over complete rows; one aggregation for all pairs."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.dropna(subset=columns).agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r")
    out = long.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "r")
    return out.filter(F.abs("r") >= weak).withColumn("class", F.when(F.abs("r") >= strong, "strong").otherwise("weak"))


def spearman_matrix(df: DataFrame, columns: list[str], key: str = "fid") -> DataFrame:
    """(a, b, r): Pearson's correlation of average ranks, over complete rows. All columns are ranked together, as one long table."""
    rows = df.dropna(subset=columns).select(key, *[F.col(c).cast("double").alias(c) for c in columns])
    long = rows.unpivot(key, columns, "column", "value")
    ranked = long.join(average_ranks(long, "value", ["column"]), ["column", "value"]).groupBy(key).pivot("column", columns).agg(F.first("rank"))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    out = ranked.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs]).unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r")
    return out.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "r")


def histogram(df: DataFrame, columns: list[str], bins: int = 30) -> DataFrame:
    """(column, bin from 1, n): equal widths from minimum to maximum, which belongs to the last bin; NaN and NULL left out."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    ends = long.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1, F.lit(bins))).otherwise(F.lit(1))
    return long.join(F.broadcast(ends), "column").groupBy("column", at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # a row for each named column


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(column)


def parameter_long(params: DataFrame, sets: DataFrame, columns: list[str], key: str = "fid") -> DataFrame:
    """(parameter, value, set) of the runs of each set; ``sets``: (set, fid)."""
    long = params.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(key, columns, "parameter", "value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value")).join(sets, key).select("set", key, "parameter", "value")


def feature_importance(df: DataFrame, features: list[str], outcome: str, trees: int = 500, seed: int = 1) -> DataFrame:
    """(feature, importance, permuted, r), largest importance first, of a random forest. ``permuted``: how much the forest's squared error grows, as a share of the
    outcome's variance, when a feature takes the values of other rows; ``r``: the feature's correlation with the outcome, for its sign.

    All features are permuted in one pass: each row meets a row drawn by position, one of the rows in the order of a digest. A forest tells rows apart only by
    its thresholds, so rows that lie between the same ones are a cell, which is predicted once, whatever the rows: a feature has fewer thresholds than bins.
    The rows' number, mean and variance give each cell's errors. The rows are made once and kept, as they are read many times."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import RandomForestRegressor

    spark, kept = df.sparkSession, scratch(df.sparkSession)
    df.dropna(subset=[*features, outcome]).select(*[F.col(c).cast("double").alias(c) for c in (*features, outcome)]).write.parquet(kept)
    rows = spark.read.parquet(kept)
    model = RandomForestRegressor(featuresCol="_f", labelCol=outcome, numTrees=trees, seed=seed).fit(VectorAssembler(inputCols=features, outputCol="_f").transform(rows))
    told = spark.createDataFrame([(f, float(x)) for f, x in zip(features, model.featureImportances.toArray())], "feature STRING, importance DOUBLE")
    ends: list[set[float]] = [set() for _ in features]
    for j, end in re.findall(r"If \(feature (\d+) <= (\S+?)\)", model.toDebugString):
        ends[int(j)].add(float(end))
    ends = [sorted(x) for x in ends]
    # a feature's value is the number of thresholds below it; the threshold itself stands for those up to it
    place = lambda j: F.size(F.filter(F.array(*map(F.lit, ends[j])), lambda e: e < F.col(features[j]))) if ends[j] else F.lit(0)
    stands = [F.array(*map(F.lit, [*x, math.nextafter(x[-1], math.inf) if x else 0.0])) for x in ends]
    # two orders of the same rows; equal rows may change places
    own = rows.select(F.col(outcome).alias("_y"), F.array(*map(place, range(len(features)))).alias("_own"), *[hashed(seed + k, *[F.col(c) for c in (*features, outcome)]).cast("double").alias(f"_h{k}") for k in (0, 1)])
    left = numbered(own, "_h0", "_h1", "_at").select("_at", "_y", "_own")
    right = numbered(own, "_h1", "_h0", "_at").select("_at", F.col("_own").alias("_other"))
    tried = [F.struct(F.lit(f).alias("feature"), F.array(*[F.col("_other" if j == k else "_own")[j] for j in range(len(features))]).alias("x")) for k, f in enumerate(features)]
    base = F.struct(F.lit("").alias("feature"), F.col("_own").alias("x"))
    cases = left.join(right, "_at").select("_y", F.explode(F.array(base, *tried)).alias("c")).groupBy("c.x", "c.feature").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("mean"), F.var_pop("_y").alias("spread"))
    cells = cases.groupBy("x").agg(F.collect_list(F.struct("feature", "n", "mean", "spread")).alias("cases"))  # one for each feature, and one, at most
    cells = cells.select("cases", array_to_vector(F.array(*[stands[j][F.col("x")[j]] for j in range(len(features))])).alias("_f"))
    each = model.transform(cells).select("prediction", F.inline("cases"))
    error = F.col("n") * (F.col("spread") + F.pow(F.col("prediction") - F.col("mean"), 2))
    errors = each.groupBy("feature").agg((F.sum(error) / F.sum("n")).alias("mse"))
    plain = F.broadcast(errors.filter("feature = ''").select(F.col("mse").alias("plain")).crossJoin(F.broadcast(rows.agg(F.var_pop(outcome).alias("spread")))))  # one row
    permuted = errors.filter("feature <> ''").crossJoin(plain).select("feature", F.try_divide(F.col("mse") - F.col("plain"), "spread").alias("permuted"))
    signs = rows.agg(*[F.corr(f, outcome).alias(f) for f in features]).unpivot([], features, "feature", "r")
    return told.join(permuted, "feature").join(signs, "feature").select("feature", "importance", "permuted", "r").orderBy(F.desc("importance"), "feature")
