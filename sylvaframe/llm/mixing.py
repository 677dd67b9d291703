"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source. Each source is given a target: its weight's share of the total, cut at ``most`` times
its size, what is cut off being shared again by weight among the others. The repetition rate of a source is
target / size; a document is emitted floor(rate) times, and once more with probability equal to the rate's
fraction, decided by a hash of its id and a seed, so that reruns agree. In one more aggregation each source sums what it
would take with each of ``SEEDS`` seeds and keeps the one that comes nearest its target: with few or uneven documents, a single
seed may be far off.

The texts are read once for the sizes, which are written as a small table (id, source, size); all else comes from that.

The targets come from running sums over the sources ordered by size / weight: the sources that are cut are
exactly a first part of that order. The rows in that window are sources, one row for each after the
aggregation, not documents.

Defined cases: a null or empty text has size 0 and is emitted like the others; a null source is a source of its own,
last in order; sources of total size 0 have target 0 and are emitted once; rows that share an id get the same draw; an empty table gives
an empty result; extra columns are kept by ``emit``, whatever their names, and ignored by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .env import cut, packed

WORD = r"[^\x20\x09-\x0D]+"
MOST, WEIGHTS, SEED, SEEDS = 3, 3, "mix-1", 64
#: The table of targets is broadcast only up to this many rows.
FEW_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draws(doc_id: Column, seed: str = SEED) -> tuple[Column, Column]:
    """Two numbers below 2**32 that depend on the id and the seed only: the draw of seed number s is (a + s b) modulo 2**32."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f"|{seed}")))
    return tuple(F.conv(F.substring(digest, k, 8), 16, 10).cast("long") for k in (1, 9))


def copies(a: Column, b: Column, s: Column, whole: Column, part: Column) -> Column:
    """How often a row is taken: ``whole`` times, and once more if its draw is below ``part``."""
    return whole + F.when((a + s * b) % F.lit(1 << 32) < part, 1).otherwise(0)


def source_targets(sizes: DataFrame, most: int = MOST, weights: int = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size). Weights are 1..``weights`` repeating in the order of
    the sources' code points, null last."""
    return sizes.sparkSession.sql(f"""
        WITH weighed AS (
            SELECT source, source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {weights} + 1 AS weight
            FROM {{sizes}}),
        sums AS (
            SELECT *, sum({most} * source_size) OVER before AS caps, sum(weight) OVER before AS gone,
                   sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight
            FROM weighed
            WINDOW before AS (ORDER BY source_size / weight, weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        cut AS (
            SELECT *, {most} * source_size * (all_weight - coalesce(gone, 0)) <= weight * (total - coalesce(caps, 0)) AS full
            FROM sums),
        shared AS (
            SELECT *, sum(CASE WHEN full THEN {most} * source_size ELSE 0 END) OVER () AS cut_size,
                   sum(CASE WHEN full THEN weight ELSE 0 END) OVER () AS cut_weight
            FROM cut)
        SELECT source, source_size,
               CASE WHEN full THEN CAST({most} * source_size AS DOUBLE)
                    ELSE CAST(weight * (total - cut_size) AS DOUBLE) / (all_weight - cut_weight) END AS target
        FROM shared""", sizes=sizes)  # fmt: skip


def known(table: DataFrame) -> DataFrame:
    """A table with a row for each source, to be joined: broadcast only if it is small, else a sort-merge join, whose hot sources adaptive
    execution splits."""
    return F.broadcast(table) if table.count() <= FEW_SOURCES else table


def plan(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", most: int = MOST, weights: int = WEIGHTS, seed: str = SEED, seeds: int = SEEDS) -> tuple[DataFrame, DataFrame]:
    """(sizes, sources): (doc_id, source, size) for each row of ``docs``; for each source its (mixed_source, source_size, target), and
    (whole, part, pick): what ``copies`` needs."""
    sizes = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "sizes")
    targets = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), most, weights)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    targets = targets.select(F.col("source").alias("mixed_source"), "source_size", "target", rate.alias("rate"))
    targets = known(cut(targets.select("*", F.floor("rate").cast("long").alias("whole"), F.floor((F.col("rate") - F.floor("rate")) * float(1 << 32)).cast("long").alias("part")), "targets"))
    a, b = draws(F.col("doc_id"), seed)
    rows = sizes.select("source", "size", a.alias("a"), b.alias("b")).join(targets, F.col("source").eqNullSafe(F.col("mixed_source")))
    each = [F.sum(F.col("size") * copies(F.col("a"), F.col("b"), F.lit(s), F.col("whole"), F.col("part"))).alias(f"t{s}") for s in range(seeds)]
    taken = rows.groupBy("mixed_source", "source_size", "target", "whole", "part").agg(*each)
    near = F.array_min(F.array(*(F.struct(F.abs(F.col(f"t{s}") - F.col("target")).alias("off"), F.lit(s).alias("s")) for s in range(seeds))))
    sources = taken.select("mixed_source", "source_size", "target", "whole", "part", near["s"].alias("pick"))
    return sizes, known(cut(sources, "sources"))


def emit(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", seed: str = SEED, **kw) -> DataFrame:
    """The mixed rows themselves, each as often as it is taken, with the columns of ``docs``."""
    _, sources = plan(docs, source=source, doc_id=doc_id, seed=seed, **kw)
    rows = packed(docs).join(sources, F.col("row")[source].eqNullSafe(F.col("mixed_source")))
    times = copies(*draws(F.col("row")[doc_id], seed), F.col("pick"), F.col("whole"), F.col("part")).cast("int")
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")


def mixed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs``."""
    sizes, sources = plan(docs)
    rows = sizes.join(sources, F.col("source").eqNullSafe(F.col("mixed_source")))
    times = copies(*draws(F.col("doc_id")), F.col("pick"), F.col("whole"), F.col("part"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


SQL = """
WITH sized AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
    FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
    SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM sizes),
sums AS (
    SELECT *, CAST(coalesce(sum(3 * source_size) OVER before, 0) AS BIGINT) AS caps,
           CAST(coalesce(sum(weight) OVER before, 0) AS BIGINT) AS gone,
           CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS all_weight
    FROM weighed
    WINDOW before AS (ORDER BY source_size / weight, weight, source NULLS FIRST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT *, 3 * source_size * (all_weight - gone) <= weight * (total - caps) AS full_up FROM sums),
shared AS (
    SELECT *, CAST(sum(CASE WHEN full_up THEN 3 * source_size ELSE 0 END) OVER () AS BIGINT) AS cut_size,
           CAST(sum(CASE WHEN full_up THEN weight ELSE 0 END) OVER () AS BIGINT) AS cut_weight
    FROM cut),
targets AS (
    SELECT source, source_size,
           CASE WHEN full_up THEN CAST(3 * source_size AS DOUBLE)
                ELSE CAST(weight * (total - cut_size) AS DOUBLE) / (all_weight - cut_weight) END AS target
    FROM shared),
rated AS (
    SELECT *, CAST(floor(rate) AS BIGINT) AS whole, CAST(floor((rate - floor(rate)) * 4294967296.0::DOUBLE) AS BIGINT) AS part
    FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0::DOUBLE END AS rate FROM targets)),
drawn AS (
    SELECT d.*, t.source_size, t.target, t.whole, t.part,
           CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|mix-1'), 1, 8) AS BIGINT) AS a,
           CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|mix-1'), 9, 8) AS BIGINT) AS b
    FROM sized d JOIN rated t ON d.source IS NOT DISTINCT FROM t.source),
tried AS (
    SELECT source, s, CAST(sum(size * (whole + CASE WHEN (a + s * b) % 4294967296 < part THEN 1 ELSE 0 END)) AS BIGINT) AS total, any_value(target) AS target
    FROM drawn, range(64) AS seeds(s) GROUP BY source, s),
picked AS (SELECT source, s, row_number() OVER (PARTITION BY source ORDER BY abs(CAST(total AS DOUBLE) - target), s) AS n FROM tried)
SELECT d.doc_id, d.size, d.source_size, d.target,
       CAST(d.size * (d.whole + CASE WHEN (d.a + p.s * d.b) % 4294967296 < d.part THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn d JOIN picked p ON d.source IS NOT DISTINCT FROM p.source AND p.n = 1
"""
