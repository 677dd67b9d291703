"""A Merkle manifest of a table: every row a leaf, a tree for each key (language), and a tree over the keys' roots.

A tree is cut into aligned blocks of ``2**BITS`` nodes that follow one another. Within a block a tree is persistent: changing a leaf
makes a version that shares every untouched node with the original and copies the leaf's ancestors only (``Node``, ``put``). The blocks' roots are the leaves of the
next round, which is the same job over a table smaller by that factor, until each key has one node; the keys' roots are then numbered and
climb in the same way. A version's upper nodes are copied along the path that its block has above it.

The jobs: leaves by built-in functions, written once; places of the leaves within their keys by a range exchange and sums over its parts; the
blocks' roots; the rounds above, whose tables are small; and the blocks again, each with its path to the root, for versions and proofs.
No step holds more than a block, whatever the size of a key.

Defined cases: rows are ordered by id (null first), those that share one by their leaf; a null key is a key of its own, before all others; a lone leaf is its
key's root and a lone key's root is the root; a proof without siblings is the digest of nothing; a null number stays null when it is
tampered with; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import lookup
from .env import cut, ready, spread

#: A block has 2**BITS nodes of a level.
BITS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "key string, place long, n long, digest binary"
#: Steps of a path: no sibling, a sibling to the right, a sibling to the left.
ALONE, RIGHT, LEFT = b"-", b"r", b"l"


def leaf_of(values: dict[str, Column]) -> Column:
    """The digest of a row's values: each one ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    said = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (c.cast("string") for c in values.values())]
    return F.unhex(F.sha2(F.concat(*said), 256))


def parent(*children: bytes) -> bytes:
    """The digest of a run of nodes: of their digests as hex text."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


class Node(NamedTuple):
    digest: bytes
    left: Node | None = None
    right: Node | None = None


def plant(digests: list[bytes], height: int) -> Node:
    """The tree of a block's nodes, as high as asked."""
    level = [Node(d) for d in digests]
    for _ in range(height):
        level = [join(*level[k : k + 2]) for k in range(0, len(level), 2)]
    return level[0]


def join(left: Node, right: Node | None = None) -> Node:
    return Node(parent(left.digest) if right is None else parent(left.digest, right.digest), left, right)


def put(tree: Node, height: int, place: int, digest: bytes) -> Node:
    """The version of the tree with another leaf: its ancestors are copied, all else is shared."""
    if not height:
        return Node(digest)
    if place >> (height - 1) & 1:
        return join(tree.left, put(tree.right, height - 1, place - (1 << (height - 1)), digest))
    return join(put(tree.left, height - 1, place, digest), tree.right)


def path(tree: Node, height: int, place: int) -> bytes:
    """The siblings from a leaf to the root, each a step and its digest."""
    steps = []
    for k in reversed(range(height)):
        if place >> k & 1:
            steps.append(LEFT + tree.left.digest)
            tree = tree.right
        else:
            steps.append(RIGHT + tree.right.digest if tree.right else ALONE)
            tree = tree.left
    return b"".join(reversed(steps))


def siblings(steps: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at < len(steps):
        kind = steps[at : at + 1]
        size = 0 if kind == ALONE else 32
        yield kind, steps[at + 1 : at + 1 + size]
        at += 1 + size


def fold(digest: bytes, steps: bytes) -> bytes:
    """The root that a node and its siblings give."""
    for kind, other in siblings(steps):
        digest = parent(digest) if kind == ALONE else parent(digest, other) if kind == RIGHT else parent(other, digest)
    return digest


def proof(steps: bytes) -> str:
    return hashlib.sha256("".join(d.hex() for _, d in siblings(steps)).encode()).hexdigest()


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``place``, the row's number in its ``key`` in this order from 0, and ``n``, the rows of the key. The rows are dealt by ranges of
    key and order, so a key of any size lies in as many parts as it needs. ``df``: a written table."""
    by = ["key", *order]
    dealt = cut(df.repartitionByRange(spread(df), *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "placed")
    spans = dealt.groupBy("key", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    key = W.partitionBy("key")
    before = F.coalesce(F.sum("_rows").over(key.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = lookup(spans.select("key", "_part", "_first", before.alias("_before"), F.sum("_rows").over(key).alias("n")), "spans")
    return dealt.join(spans, ["key", "_part"]).withColumn("place", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def block(bits: int) -> Column:
    return F.shiftright("place", bits).alias("block")


def sorted_block(table, bits: int):
    """(table in order, digests, height, first place) of a block; the last blocks of a key are as high as the others."""
    table = table.sort_by("place")
    n = table.column("n")[0].as_py()
    return table, table.column("digest").to_pylist(), min(bits, (n - 1).bit_length()), table.column("place")[0].as_py()


def block_roots(nodes: DataFrame, bits: int) -> DataFrame:
    """The nodes of the next round: a block's root each."""
    import pyarrow as pa

    def run(table):
        table, digests, height, first = sorted_block(table, bits)
        return pa.table([[table.column("key")[0].as_py()], [first >> bits], [-(-table.column("n")[0].as_py() >> bits)], pa.array([plant(digests, height).digest], pa.binary())], names=["key", "place", "n", "digest"])

    return nodes.select("key", "place", "n", "digest", block(bits)).groupBy("key", "block").applyInArrow(run, NODES)


def block_paths(nodes: DataFrame, bits: int) -> DataFrame:
    """(key, place, block, steps, digest): of every node the steps to its block's root, and that root."""
    import pyarrow as pa

    def run(table):
        table, digests, height, first = sorted_block(table, bits)
        tree = plant(digests, height)
        steps = [path(tree, height, k) for k in range(len(digests))]
        return pa.table([table.column("key"), table.column("place"), table.column("block"), pa.array(steps, pa.binary()), pa.array([tree.digest] * len(steps), pa.binary())], names=["key", "place", "block", "steps", "digest"])

    return nodes.select("key", "place", "n", "digest", block(bits)).groupBy("key", "block").applyInArrow(run, "key string, place long, block long, steps binary, digest binary")


def climb(nodes: DataFrame, bits: int) -> DataFrame:
    """(key, place, steps, root) for every node of a written table (key, place, n, digest): all steps to the root of its key. A round for each
    factor of 2**bits in the largest key."""
    rounds = []
    while True:
        paths = cut(block_paths(nodes, bits), "paths")
        rounds.append(paths)
        if (nodes.agg(F.max("n")).first()[0] or 0) <= 1 << bits:
            break
        nodes = cut(paths.groupBy("key", "block").agg(F.first("digest").alias("digest")).withColumnRenamed("block", "place").withColumn("n", F.count("*").over(W.partitionBy("key"))), "nodes")
    done = rounds.pop().select("key", "place", "steps", F.col("digest").alias("root"))
    for paths in reversed(rounds):
        above = lookup(done.select("key", F.col("place").alias("block"), F.col("steps").alias("above"), "root"), "above")
        done = paths.join(above, ["key", "block"]).select("key", "place", F.concat("steps", "above").alias("steps"), "root")
    return done


def key_of(c: Column) -> Column:
    """A key that orders as the values do, null first."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def manifest(docs: DataFrame, tampered: Column | None = None, changed: dict[str, Column] | None = None, key: str = "lang", fields: tuple[str, ...] = FIELDS, doc_id: str = "doc_id", bits: int = BITS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row; rows for which ``tampered`` is true make a version of the
    tree with the values ``changed`` in place of their own."""
    import pyarrow as pa

    ready(docs.sparkSession, 4096)
    own = {f: F.col(f) for f in fields}
    other = F.when(F.coalesce(tampered, F.lit(False)), leaf_of(own | (changed or {}))) if tampered is not None else F.lit(None).cast("binary")
    leaves = cut(docs.select(F.col(doc_id).alias("_id"), key_of(F.col(key)).alias("key"), leaf_of(own).alias("digest"), other.alias("other")), "leaves")
    leaves = cut(numbered(leaves, ["_id", "digest"]).withColumn("block", block(bits)), "leaves")
    tops = cut(block_roots(leaves, bits), "tops")
    inner = cut(climb(tops, bits).withColumnRenamed("steps", "inner"), "inner")
    subroots = cut(inner.filter("place = 0").select(F.lit("").alias("key"), F.col("key").alias("name"), F.col("root").alias("digest")), "subroots")
    subroots = cut(numbered(subroots, ["name"]), "subroots")
    outer = lookup(climb(subroots, bits).join(subroots.select("place", "name", F.col("digest").alias("subroot")), "place").select(F.col("name").alias("key"), "steps", "root", "subroot"), "outer")
    above = inner.drop("root").join(outer, "key").select("key", F.col("place").alias("block"), F.concat("inner", "steps").alias("steps"), "subroot", "root")

    def finish(left, right):
        if not len(left):
            return pa.table([[] for _ in schema], schema=schema)
        table, digests, height, _ = sorted_block(left, bits)
        up, subroot, root = (right.column(c)[0].as_py() for c in ("steps", "subroot", "root"))
        tree, out = plant(digests, height), []
        for k, (leaf, changed) in enumerate(zip(digests, table.column("other").to_pylist())):
            steps = path(tree, height, k)
            folded = fold(leaf, steps + up) if changed is None else fold(put(tree, height, k, changed).digest, up)
            out.append((leaf.hex(), subroot.hex(), root.hex(), proof(steps + up), folded.hex(), folded == root))
        return pa.table([table.column("_id"), *(pa.array(x) for x in zip(*out))], names=schema.names)

    id_type = docs.schema[doc_id].dataType.simpleString()
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    schema = pa.schema([("doc_id", {"bigint": pa.int64(), "int": pa.int32()}.get(id_type, pa.string())), *((x, pa.string()) for x in names), ("verified", pa.bool_())])
    rows = leaves.select("_id", "key", "block", "place", "n", "digest", "other").groupBy("key", "block").cogroup(above.groupBy("key", "block"))
    return rows.applyInArrow(finish, f"doc_id {id_type}, " + ", ".join(f"{x} string" for x in names) + ", verified boolean")


def audited(docs: DataFrame) -> DataFrame:
    """The manifest of documents of which those where 7 divides the crc32 of the id have one more in ``n_chars``."""
    return manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1})


_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in FIELDS) + ")"
_CRC = """xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT),
       lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))))"""
SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_LEAF} AS leaf,
         CASE WHEN {_CRC} % 7 = 0 THEN {_LEAF.replace("n_chars", "(n_chars + 1)")} END AS other
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), inner_nodes AS (
  SELECT lang, 0 AS level, place, n, leaf AS digest FROM placed
  UNION ALL
  SELECT lang, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM inner_nodes WHERE n > 1 GROUP BY lang, level, place // 2, n
), subroots AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM inner_nodes WHERE n = 1
), outer_nodes AS (
  SELECT 0 AS level, place, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM outer_nodes WHERE n > 1 GROUP BY level, place // 2, n
), walk AS (
  SELECT p.lang, p.place AS row_place, 0 AS level, p.place, p.n, coalesce(other, leaf) AS digest, '' AS proof FROM placed p
  UNION ALL
  SELECT w.lang, w.row_place, w.level + 1, w.place // 2, (w.n + 1) // 2,
         sha256(CASE WHEN w.place % 2 = 0 THEN w.digest || coalesce(s.digest, '') ELSE s.digest || w.digest END), w.proof || coalesce(s.digest, '')
  FROM walk w LEFT JOIN inner_nodes s ON s.lang IS NOT DISTINCT FROM w.lang AND s.level = w.level AND s.place = xor(w.place, 1) WHERE w.n > 1
), upper AS (
  SELECT w.lang, w.row_place, 0 AS level, r.place, r.n, w.digest, w.proof FROM walk w JOIN subroots r ON r.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL
  SELECT u.lang, u.row_place, u.level + 1, u.place // 2, (u.n + 1) // 2,
         sha256(CASE WHEN u.place % 2 = 0 THEN u.digest || coalesce(s.digest, '') ELSE s.digest || u.digest END), u.proof || coalesce(s.digest, '')
  FROM upper u LEFT JOIN outer_nodes s ON s.level = u.level AND s.place = xor(u.place, 1) WHERE u.n > 1
)
SELECT p.doc_id, p.leaf, r.subroot, t.digest AS root, sha256(u.proof) AS proof_sha256, u.digest AS folded_root, u.digest = t.digest AS verified
FROM placed p
JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang
JOIN upper u ON u.lang IS NOT DISTINCT FROM p.lang AND u.row_place = p.place AND u.n = 1
CROSS JOIN (SELECT digest FROM outer_nodes WHERE n = 1) t
"""
