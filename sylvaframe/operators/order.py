"""Ranks and exact quantiles of large sets without a task that holds them: values are dealt to ranges whose ends come from
approximate quantiles, ranges are ordered by themselves, and sums over the ranges, a row each, put them one after the other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of one set; the accuracy of approximate quantiles, and the size up to which a group is taken as it is.
RANGES, ACCURACY = 128, 10_000


def in_ranges(df: DataFrame, column: str, keys: Sequence[str] = (), ranges: int = RANGES) -> DataFrame:
    """``df`` with ``_range``, which rises with the column: equal values have one range. NULL belongs to the first."""
    ends = df.groupBy(*keys).agg(F.percentile_approx(column, [k / ranges for k in range(1, ranges)], ACCURACY).alias("_ends"))
    rows = df.join(ends, list(keys)) if keys else df.crossJoin(F.broadcast(ends))  # one row of RANGES numbers
    return rows.withColumn("_range", F.coalesce(F.size(F.filter("_ends", lambda e: e < F.col(column))), F.lit(0))).drop("_ends")


def before_ranges(counts: DataFrame, n: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, _range, _before): how many there are in the ranges before, from counts by range; a row for each range."""
    each = counts.groupBy(*keys, "_range").agg(F.sum(n).alias("_n"))
    order = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    return each.select(*keys, "_range", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))


def average_ranks(long: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, column, rank) of the distinct values of a column within the keys: ranks with ties averaged."""
    counts = in_ranges(long.select(*keys, column), column, keys).groupBy(*keys, "_range", column).agg(F.count(F.lit(1)).alias("_n"))
    order = W.partitionBy(*keys, "_range").orderBy(column).rowsBetween(W.unboundedPreceding, -1)
    rank = F.col("_before") + F.coalesce(F.sum("_n").over(order), F.lit(0)) + (F.col("_n") + 1) / 2.0
    return counts.join(before_ranges(counts, "_n", keys), [*keys, "_range"]).select(*keys, column, rank.alias("rank"))


def numbered(df: DataFrame, column: str, key: str, position: str = "position") -> DataFrame:
    """``df`` with the position, from 1, of each row in the order of the column, then the key."""
    rows = in_ranges(df, column)
    before = before_ranges(rows.withColumn("_one", F.lit(1)), "_one")
    at = F.col("_before") + F.row_number().over(W.partitionBy("_range").orderBy(column, key))
    return rows.join(F.broadcast(before), "_range").withColumn(position, at.cast("int")).drop("_range", "_before")


def nearest_values(want: DataFrame, have: DataFrame, column: str, found: str) -> DataFrame:
    """(column, found): for each distinct value of ``want`` the nearest of the values of ``have``, ties to the smaller."""
    both = have.select(F.col(column).cast("double").alias("v"), F.lit(True).alias("is_have")).distinct().unionByName(want.select(F.col(column).cast("double").alias("v"), F.lit(False).alias("is_have")).distinct())
    both = in_ranges(both.filter("v IS NOT NULL"), "v")
    own = F.when(F.col("is_have"), F.col("v"))
    w = W.partitionBy("_range").orderBy("v", F.desc("is_have"))
    rows = both.withColumns({"below": F.last(own, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), "above": F.first(own, ignorenulls=True).over(W.partitionBy("_range").orderBy("v", "is_have").rowsBetween(0, W.unboundedFollowing))})
    ends = both.groupBy("_range").agg(F.min(own).alias("lo"), F.max(own).alias("hi"))  # a row for each range
    ranges = W.orderBy("_range")
    ends = ends.select("_range", F.last("hi", ignorenulls=True).over(ranges.rowsBetween(W.unboundedPreceding, -1)).alias("last"), F.first("lo", ignorenulls=True).over(ranges.rowsBetween(1, W.unboundedFollowing)).alias("next"))
    rows = rows.filter(~F.col("is_have")).join(F.broadcast(ends), "_range").withColumns({"below": F.coalesce("below", "last"), "above": F.coalesce("above", "next")})
    near = F.when(F.col("above").isNull() | (F.col("v") - F.col("below") <= F.col("above") - F.col("v")), F.col("below")).otherwise(F.col("above"))
    return rows.select(F.col("v").alias(column), near.alias(found))


def exact_quantiles(df: DataFrame, q: Sequence[float], keys: Sequence[Column | str], value: str = "value") -> DataFrame:
    """(keys, mean, _q: array of the quantiles) for groups of any size: exact, interpolated between neighbours. Approximate quantiles
    tell for each wanted one between which values it lies, with a margin of three times their error; only those values are ordered."""
    rows = df.select(*keys, F.col(value).alias("_v"))
    names = rows.columns[:-1]
    near = [min(1.0, max(0.0, x + side * 3 / ACCURACY)) for x in q for side in (-1, 1)]
    stats = rows.groupBy(*names).agg(F.avg("_v").alias("mean"), F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.percentile_approx("_v", near, ACCURACY).alias("_near"))
    end = lambda own, k: F.when(F.col("_n") <= ACCURACY, F.col(own)).otherwise(F.col("_near")[k])
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(x)) * (F.col("_n") - 1)).alias("place"), end("_lo", 2 * i).alias("lo"), end("_hi", 2 * i + 1).alias("hi")) for i, x in enumerate(q)])

    def beside(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        """Joined by the keys, NULL included; without keys, one row on the right."""
        if not names:
            return left.crossJoin(F.broadcast(right))
        right = right.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(names)})
        on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(names)])
        return left.join(right, on, how).drop(*[f"_k{i}" for i in range(len(names))])

    # a value below a bracket counts for it, a value inside is kept with its number
    parts = beside(rows.filter("_v IS NOT NULL"), stats.select(*names, wanted.alias("_w"))).select(*names, "_v", F.explode("_w").alias("_w"))
    parts = parts.filter(F.col("_v") <= F.col("_w.hi")).groupBy(*names, F.col("_w.i").alias("_i"), F.col("_w.place").alias("_place"), F.when(F.col("_v") >= F.col("_w.lo"), F.col("_v")).alias("_in")).agg(F.count(F.lit(1)).alias("_c"))
    order = W.partitionBy(*names, "_i").orderBy(F.col("_in").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    ranked = parts.withColumn("_upto", F.sum("_c").over(order))
    low, high = (F.min(F.when(F.col("_upto") > at("_place"), F.col("_in"))) for at in (F.floor, F.ceil))
    beyond = F.first(F.col("_place") - F.floor("_place"))
    each = ranked.groupBy(*names, "_i").agg(F.when(beyond == 0, low).otherwise(low * (1 - beyond) + high * beyond).alias("_value"))
    found = each.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_value"))).alias("_m"))  # an entry for each quantile
    return beside(stats, found, "left").select(*names, "mean", F.array(*[F.element_at("_m", F.lit(i)) for i in range(len(q))]).alias("_q"))
