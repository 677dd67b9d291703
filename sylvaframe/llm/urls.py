"""URL filters as a sort-merge range join.

A host is turned around, label by label, each label ended by ``\\x01`` (a byte 0 or 1 of a label is escaped): the hosts below a rule's host are then exactly the
keys that begin with the rule's key, an interval. Urls and rules are dealt to the same ranges of keys, sorted, and
swept once: a rule's host is pushed on a stack when the sweep enters its interval and popped when it leaves; as prefix
intervals are nested or disjoint, the stack holds exactly the rule hosts that a url's host lies below. Their path
rules decide by prefix; the longest rule (host and path together, then host) wins.

Ranges: the driver draws at most ``MOST_RANGES`` boundaries from a sample of keys of a fixed size, as Spark's own range partitioning does. More parts than that share
the ranges: the rows of a range are dealt over its parts by a hash, and its rules are in all of them. A rule goes to every part that its interval touches. A key that is several boundaries (a hot url or
host) spans several parts, and its rows are dealt over all of them by a hash; the rules for it are in all of them.
The boundaries decide only where a row is judged, never how.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no rule; it and every url that
fits none gets the method's verdict ``default``; rows that share an id or url are judged each; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .env import ready, spread

#: Fixed rules of the registered query: (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Sampled keys for each boundary, and boundaries at most.
SAMPLE, MOST_RANGES = 40, 4096


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.expr("substring({0}, locate('://', {0}) + 3)".format("_url"))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), *LOWER)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """``www.example.org`` -> ``org\\x01example\\x01www\\x01``; an empty host has an empty key."""
    plain = F.replace(F.replace(host, F.lit("\x00"), F.lit("\x000")), F.lit("\x01"), F.lit("\x001"))
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(plain, r"\.")), "\x01"), F.lit("\x01")))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame([(v, h, p) for v, h, p in rules], "verdict string, host string, path string")


def sweep(batches: Iterator, default: str) -> Iterator:
    """Over rows sorted by (part, key, rules first): (page_id, host, path, rule, verdict) of the urls."""
    import pyarrow as pa

    part, stack = None, []  # of (host key, {path: (rule, verdict)}, lengths of the paths)
    for batch in batches:
        out = []
        for at, key, is_url, page_id, host, path, verdict in zip(*(batch.column(c).to_pylist() for c in ("_part", "_key", "_is_url", "page_id", "host", "path", "_verdict"))):
            if at != part:
                part, stack = at, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, []))
                paths, lengths = stack[-1][1:]
                if path not in paths:
                    paths[path] = (host + path, verdict)
                if len(path) not in lengths:
                    lengths.append(len(path))
                    lengths.sort(reverse=True)
                continue
            best = None
            for _, paths, lengths in reversed(stack):  # longer hosts first, so ties are theirs
                for n in lengths:
                    if n <= len(path) and (hit := paths.get(path[:n])):
                        if best is None or len(hit[0]) > len(best[0]):
                            best = hit
                        break
            out.append((page_id, host, path, *(best or (None, default))))
        kinds = (pa.int64(), *[pa.string()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, kinds)], ["page_id", "host", "path", "rule", "verdict"])


def deal(batches: Iterator, bounds: list[str], fan: int = 1) -> Iterator:
    """The part of each url, and each rule once for every part that its interval touches. A key's ranges are those from the
    boundaries below it to the ones not above it; each range has ``fan`` parts."""
    import pyarrow as pa

    for batch in batches:
        take, parts = [], []
        for i, (key, is_url, page_id, path) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_key", "_is_url", "page_id", "path")))):
            first = bisect_left(bounds, key)
            if is_url:
                ranges = bisect_right(bounds, key) - first + 1
                draw = crc32(f"{page_id}{path}".encode()) if ranges * fan > 1 else 0
                parts.append((first + draw % ranges) * fan + draw // ranges % fan)
                take.append(i)
            else:
                beyond = bisect_left(bounds, key[:-1] + "\x02") if key else len(bounds)  # keys end with a 1
                span = range(first * fan, (beyond + 1) * fan)
                parts += span
                take += [i] * len(span)
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *batch.take(pa.array(take, pa.int64())).columns], ["_part", *batch.schema.names])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", page_id: str = "page_id", parts: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``; ``rules``: (verdict, host, path)."""
    ready(pages.sparkSession, 5000)
    parts = parts or spread(pages)
    host, path = host_and_path(F.col("_url"))
    urls = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("_url")).select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("_key", host_key(F.col("host")))
    n = urls.count()
    ranges = min(parts, MOST_RANGES)
    fan = -(-parts // ranges)
    share = min(1.0, SAMPLE * ranges / max(n, 1))
    seen = sorted(r[0] for r in urls.select("_key").sample(share, 7).limit(2 * SAMPLE * ranges).collect())  # of a fixed size
    bounds = [seen[len(seen) * k // ranges] for k in range(1, ranges)] if seen else []
    columns = "_part int, _key string, _is_url boolean, page_id long, host string, path string, _verdict string"
    rules = rules.select(F.col("verdict").alias("_verdict"), F.translate("host", *LOWER).alias("host"), "path").withColumn("_key", host_key(F.col("host")))
    rows = urls.select("_key", F.lit(True).alias("_is_url"), "page_id", "host", "path", F.lit(None).cast("string").alias("_verdict")).unionByName(
        rules.select("_key", F.lit(False).alias("_is_url"), F.lit(None).cast("long").alias("page_id"), "host", "path", "_verdict")
    )
    rows = rows.mapInArrow(lambda batches: deal(batches, bounds, fan), columns)
    rows = rows.repartition(ranges * fan, "_part").sortWithinPartitions("_part", "_key", "_is_url", "path", "_verdict")
    return rows.mapInArrow(lambda b: sweep(b, default), "page_id long, host string, path string, rule string, verdict string")


SQL = """
WITH parts AS (
    SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest
    FROM pages),
split AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM parts),
rules(verdict, host, path) AS (VALUES
    ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
    SELECT s.page_id, s.host, s.path, r.host || r.path AS rule, r.verdict,
           row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS n
    FROM split s LEFT JOIN rules r
      ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE n = 1
"""
