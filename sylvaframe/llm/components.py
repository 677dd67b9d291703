"""Connected components of links between 64-bit nodes.

Each task first contracts at most about ``CONTRACTED`` links to stars by itself; where more than one task was needed,
alternating large-star and small-star steps, which are joins, bring the stars together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .env import cut, ready

#: Tables of fixed-width rows are broadcast only up to this many; beyond, they are joined by sort and merge.
FEW = 500_000
CONTRACTED = 1_000_000


def lookup(df: DataFrame, name: str = "lookup") -> DataFrame:
    """The table written once; to be broadcast if it is small. A larger one is a plain scan, so that adaptive
    execution can split a hot key of what is joined to it."""
    out = cut(df, name)
    return F.broadcast(out) if out.count() <= FEW else out


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that it is connected with), without the smallest ones themselves."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    up = np.arange(len(names))
    while True:
        least = np.minimum(up[a], up[b])
        before = up.copy()
        np.minimum.at(up, before[a], least)
        np.minimum.at(up, before[b], least)
        while (up != up[up]).any():
            up = up[up]
        if (up == before).all():
            break
    mine = np.flatnonzero(up != np.arange(len(names)))
    return names[mine], names[up[mine]]


def contract(batches: Iterator) -> Iterator:
    import pyarrow as pa

    held = [[batch.column(c).to_numpy() for c in ("u", "v")] for batch in batches]
    if held:
        u, v = stars(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the component is its smallest node. The steps go on until nothing changes;
    their number grows with the logarithm of the longest chain of stars."""
    ready(links.sparkSession)
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    tasks = math.ceil(edges.count() / CONTRACTED)
    edges = cut(edges.coalesce(max(tasks, 1)).mapInArrow(contract, "u long, v long"), "edges")
    seen = None
    while tasks > 1:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = lookup(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(large, "edges")
        least = lookup(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        near = large.join(least, "u")
        small = near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
