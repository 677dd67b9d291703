"""N-gram Jaccard join by a token-group matrix.

A document's set are its distinct 5-word shingles, as 64-bit hashes with a secret key of the run (``windows.keyed``). Two documents link when their sets' Jaccard similarity is
at least 80 %. Equal texts are collapsed before (``exact``); the jobs work on different texts, "nodes".

* Tokens are ordered by how frequent they are, from a table of ``2**SKETCH_BITS`` counters (a fixed size), then by hash. Two
  similar sets share a token among the rarest n - ceil(0.8 n) + 1 of each, so only these go into the matrix.
* Tokens of the very same nodes are kept once, under a name made of the nodes.
* A node is dropped when too few of its rare tokens occur in any other node of a fitting size, the bound for the group of
  all others: the odd members of a large group of half-similar texts are never compared one by one.
* Grouping: each token's nodes are proposed to a few of them as neighbours, a number of pairs linear in the nodes;
  verified pairs form groups of similar documents.
* The matrix: (token, group), the union of its members' rare tokens, cut to the members whose sizes fit the query's (each at least
  80 % of the other). A node is a query against every group but its own. Its overlap with a group's union, added up over the matrix, bounds its
  overlap with each member, and the group is opened only if that reaches what the sizes ask for. Tokens whose lists are
  long (``LISTED``) are not added up by group: all that a query has of them counts for each group.
* An opened group's members that share a listed token with the query are compared by histograms of token hashes, an upper bound, and then exactly.
  Pairs that share only tokens of long lists meet in blocks of those lists, if both have enough of such tokens: there the full
  unions of the groups are compared first, and only links leave a task.
* Links of all steps give the components. As members of a group are connected already, pairs inside a
  group are never listed, however large it is; no link between groups is lost, since every pair of nodes that share a
  rare token lies in one group or is compared.

Defined cases: null, empty or blank text has no shingle and its own component; fewer than 5 words are one shingle, the whole
sequence; equal texts are linked if they have a word; rows that share an id count as one document for the result; a null
id is never a component's id unless there is no other; an empty table gives an empty result; extra columns are ignored by
``components_of`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exact, windows
from .components import components, lookup
from .env import cut, packed, ready, spread
from .windows import U64

SHINGLE, PERCENT = 5, 80
SKETCH_BITS, SLICES, BINS = 20, 64, 128
#: Rare tokens that a task holds before it sends them on.
HELD = 1 << 19
#: Members of each list that all others are proposed to as neighbours.
CENTRES = 6
#: A list with more pairs of nodes of different groups than this is opened, in blocks of so many nodes, and not listed by pairs.
LISTED, OPEN = 512, 1024


def shingles(texts, key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of an Arrow array of strings: the shingles' hashes under the run's key, with repeats, and each text's first."""
    import pyarrow as pa
    import pyarrow.compute as pc

    windows.seal(key)

    body = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(body.buffers()[1], np.int64, len(body) + 1, 8 * body.offset) if len(body) else np.zeros(1, np.int64)
    raw = body.buffers()[2] if len(body) else None
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)
    hashes, at = windows.words(data, offsets - offsets[0], lower=True)
    n = np.diff(at)
    many = np.maximum(n - SHINGLE + 1, np.minimum(n, 1))  # shingles of each text
    first = np.cumsum(many) - many
    doc = np.repeat(np.arange(len(n)), many)
    a = at[doc] + np.arange(len(doc)) - first[doc]
    out = windows.chained(hashes, a, np.minimum(a + SHINGLE, at[doc + 1]) - a)
    return out, np.append(first, len(doc))


def prefix_size(n: int) -> int:
    return n - -(-n * PERCENT // 100) + 1


def similar(both: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    return 100 * both >= PERCENT * (n_a + n_b - both)


def sketch(nodes: DataFrame, key: bytes) -> np.ndarray:
    """How many shingles fall on each counter: at most ``2**SKETCH_BITS`` numbers reach the driver, in ``SLICES`` rows."""
    width = (1 << SKETCH_BITS) // SLICES

    def count(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            total += np.bincount((shingles(batch.column("text"), key)[0] >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total)).astype(np.uint32)
        if total.any():
            packed = [zlib.compress(total[k * width : (k + 1) * width].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1) for k in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(packed, pa.binary())], ["k", "counts"])

    def add(table):
        import zlib

        import pyarrow as pa

        total = np.zeros(width, np.uint64)
        for x in table.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_py()), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
        return pa.table([pa.array([table.column("k")[0].as_py()], pa.int32()), pa.array([np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())], names=["k", "counts"])

    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for r in nodes.select("text").mapInArrow(count, "k int, counts binary").groupBy("k").applyInArrow(add, "k int, counts binary").collect():
        out[r.k * width : (r.k + 1) * width] = np.frombuffer(r.counts, "<u4")
    return out


def matrix(nodes: DataFrame, counters: np.ndarray, key: bytes) -> DataFrame:
    """kind 0: (token, node, size), rare tokens that several nodes have, one for each list of nodes; kind 1: (node, node), proposed neighbours;
    kind 2: (node, size) and histogram, all nodes."""
    parts = 2 * spread(nodes)

    def send(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list = []

        def flush() -> Iterator:
            token, node, size = (np.concatenate(x) for x in list(zip(*held))[:3])
            histograms = np.stack([x[3] for x in held])
            held.clear()
            nth = np.cumsum(size < 0) - 1  # a node's own row is its last
            rows = [(p, token[i].tobytes(), node[i].tobytes(), size[i].tobytes(), histograms[nth[i[size[i] < 0]]].tobytes()) for p, i in windows.by_part(token, parts)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], ["p", "tokens", "nodes", "sizes", "histograms"])

        for batch in batches:
            found, at = shingles(batch.column("text"), key)
            for node, a, b in zip(batch.column("node").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                own = np.unique(found[a:b])
                n, bins = len(own), histogram(own)
                if n:
                    own = own[np.argsort(counters[(own >> U64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")[: prefix_size(n)]]
                # the node itself is sent like a token, with a negative size: all sizes come back with the matrix
                held.append((np.append(own, U64(node)), np.full(len(own) + 1, node, np.int64), np.append(np.full(len(own), n, np.int32), np.int32(-1 - n)), bins))
            if sum(len(x[0]) for x in held) >= HELD:
                yield from flush()
        if held:
            yield from flush()

    def group(table):
        import pyarrow as pa

        token = np.frombuffer(b"".join(windows.blobs(table.column("tokens"))), U64)
        node = np.frombuffer(b"".join(windows.blobs(table.column("nodes"))), np.int64)
        size = np.frombuffer(b"".join(windows.blobs(table.column("sizes"))), np.int32).astype(np.int64)
        histograms = np.frombuffer(b"".join(windows.blobs(table.column("histograms"))), np.uint16).reshape(-1, BINS)
        all_nodes, all_sizes = node[size < 0], -1 - size[size < 0]
        token, node, size = token[size >= 0], node[size >= 0], size[size >= 0]
        order = np.lexsort((node, size, token))
        token, node, size = token[order], node[order], size[order]
        same = np.zeros(len(token), bool)
        same[1:] = token[1:] == token[:-1]
        several = same.copy()
        several[:-1] |= same[1:]
        token, node, size, same = token[several], node[several], size[several], same[several]
        # tokens of the very same nodes say the same: one name for their list, kept once
        begin = np.flatnonzero(~same)
        if len(begin):
            name = np.add.reduceat(windows.mix(node.view(U64) ^ U64(0x2545F4914F6CDD1D)), begin)
            _, first, weight = np.unique(name, return_index=True, return_counts=True)
            kept = np.zeros(len(begin), np.int64)
            kept[first] = weight
            length = np.diff(np.append(begin, len(token)))
            token, times = np.repeat(name, length), np.repeat(kept, length)
            token, node, size, same, times = token[times > 0], node[times > 0], size[times > 0], same[times > 0], times[times > 0]
        else:
            times = np.zeros(0, np.int64)
        # of each entry, the smallest and largest size in its list, not its own, that fits
        begin = np.flatnonzero(~same)
        of = np.cumsum(~same) - 1
        end = np.append(begin[1:], len(token))
        place, own = (of << 32) + size, np.arange(len(token))
        low = np.searchsorted(place, (of << 32) - (-size * PERCENT // 100))
        high = np.searchsorted(place, (of << 32) + size * 100 // PERCENT, "right") - 1
        low, high = low + (low == own), high - (high == own)
        fits = (low <= high) & (low < end[of]) & (high >= begin[of]) if len(begin) else np.zeros(0, bool)
        low, high = np.where(fits, size[np.minimum(low, max(len(size) - 1, 0))], 0) if len(size) else size, np.where(fits, size[np.maximum(high, 0)], 0) if len(size) else size
        # proposed neighbours: the one before in the order of sizes, and some that a hash chooses for all lists alike, so
        # that the members of a large group of similar texts mostly meet the same few
        i = np.flatnonzero(same)
        a, b = [i - 1], [i]
        for seed in range(CENTRES if len(begin) else 0):
            rank = windows.mix(node.view(U64) ^ windows.mix(np.array([seed + 1], U64)))
            least = np.minimum.reduceat(rank, begin)
            centre = np.zeros(len(begin), np.int64)
            hit = np.flatnonzero(rank == least[of])
            centre[of[hit]] = hit
            a.append(centre[of])
            b.append(np.arange(len(node)))
        a, b = np.concatenate(a), np.concatenate(b)
        close = (a != b) & (100 * np.minimum(size[a], size[b]) >= PERCENT * np.maximum(size[a], size[b]))
        a, b = node[a[close]], node[b[close]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        # entries without a partner of a fitting size are left out
        token, node, size, times, low, high = token[fits], node[fits], size[fits], times[fits], low[fits], high[fits]
        none, bins = np.zeros(len(pairs) + len(all_nodes), np.int64), [None] * (len(token) + len(pairs)) + [x.tobytes() for x in histograms]
        columns = [
            np.concatenate([np.full(len(token), 0, np.int32), np.full(len(pairs), 1, np.int32), np.full(len(all_nodes), 2, np.int32)]),
            np.concatenate([token.view(np.int64), pairs[:, 0], all_nodes]),
            np.concatenate([node, pairs[:, 1], all_sizes]),
            *[np.concatenate([c, none]) for c in (size, times, low, high)],
        ]
        return pa.table([*[pa.array(c) for c in columns], pa.array(bins, pa.binary())], names=["kind", "x", "y", "size", "times", "low", "high", "histogram"])

    sent = nodes.mapInArrow(send, "p int, tokens binary, nodes binary, sizes binary, histograms binary")
    return cut(sent.groupBy("p").applyInArrow(group, "kind int, x long, y long, size long, times long, low long, high long, histogram binary"), "matrix")


def least_shared(size: str, *others: str) -> Column:
    """Two similar sets of sizes a and b have more than 80 (a + b) / 180 - 0.8 max(a, b) tokens that are among the rare ones of both;
    as a function of b this is least at an end of the range of sizes that a set can meet: ``others``."""
    return F.least(*[F.expr(f"cast(floor({PERCENT} * ({size} + {s}) / {100 + PERCENT} - {PERCENT} * greatest({size}, {s}) / 100 - 1e-9D) + 1 AS LONG)") for s in others])


def possible(found: DataFrame) -> DataFrame:
    """The entries (token, node, size, times, low, high) of nodes that can have a link at all. A node is dropped if fewer of its rare tokens
    than it needs have any other node to go with. ``times``: how many tokens the name stands for; ``low``, ``high``: the sizes of the others that fit."""
    raw = found.filter("kind = 0")
    met = raw.groupBy(F.col("y").alias("node"), "size").agg(F.sum("times").alias("met"), F.min("low").alias("low"), F.max("high").alias("high"))
    able = lookup(met.filter(F.col("met") >= least_shared("size", "low", "high")).select("node"), "able")
    entries = raw.groupBy(F.col("x").alias("token"), F.col("y").alias("node"), "size").agg(F.sum("times").alias("times"), F.min("low").alias("low"), F.max("high").alias("high"))
    return entries.join(able, "node", "left_semi")


def histogram(tokens: np.ndarray) -> np.ndarray:
    """How many tokens fall in each bin of hashes; of a set too large for the counters, all of them are at their end."""
    found = np.bincount((tokens >> U64(57)).astype(np.int64), minlength=BINS)
    return found.astype(np.uint16) if found.max() < 0xFFFF else np.full(BINS, 0xFFFF, np.uint16)


def overlap_bound(a: bytes, b: bytes) -> int:
    """At least as many tokens as two sets with these histograms share."""
    x, y = np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)
    return 1 << 40 if x[0] == 0xFFFF or y[0] == 0xFFFF else int(np.minimum(x, y).sum(dtype=np.int64))


def overlap(a: bytes, b: bytes) -> int:
    return len(np.intersect1d(np.frombuffer(a, U64), np.frombuffer(b, U64), assume_unique=True))


def sets(nodes: DataFrame, needed: DataFrame, key: bytes) -> DataFrame:
    """(node, tokens) of the needed nodes, and of a few more that a filter of a fixed size lets pass: no text is shuffled."""
    slot = F.xxhash64("node").bitwiseAND(F.lit((1 << 24) - 1))
    bits = needed.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS INT)))").alias("bits"))
    rows = nodes.withColumn("slot", slot).join(F.broadcast(bits), F.shiftright("slot", 6) == F.col("word")).filter("shiftright(bits, cast(slot & 63 AS INT)) & 1L = 1L")

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found, at = shingles(batch.column("text"), key)
            tokens = [np.unique(found[a:b]).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(tokens, pa.binary())], ["node", "tokens"])

    return rows.select("node", "text").mapInArrow(task, "node long, tokens binary")


def verify(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, key: bytes) -> DataFrame:
    """The (a, b) of ``pairs`` that link: first by the histograms' bound, then by the sets themselves. ``nodes``: node, size, histogram."""

    def keep(column: str, shared) -> Callable:
        def task(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size_a", "size_b"))
                both = np.array([shared(x.as_py(), y.as_py()) for x, y in zip(batch.column(f"{column}_a"), batch.column(f"{column}_b"))], np.int64)
                ok = pa.array(similar(both, n_a, n_b))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b", "size_a", "size_b")], ["a", "b", "size_a", "size_b"])

        return task

    schema = "a long, b long, size_a long, size_b long"
    rows = pairs.distinct()
    for side in "ab":
        rows = rows.join(nodes.select(*[F.col(c).alias(f"{c}_{side}" if c != "node" else side) for c in ("node", "size", "histogram")]), side)
    maybe = cut(rows.select("a", "b", "size_a", "size_b", "histogram_a", "histogram_b").mapInArrow(keep("histogram", overlap_bound), schema), "maybe")
    known = cut(sets(texts, maybe.select(F.explode(F.array("a", "b")).alias("node")).distinct(), key), "sets")
    rows = maybe
    for side in "ab":
        rows = rows.join(known.select(F.col("node").alias(side), F.col("tokens").alias(f"tokens_{side}")), side)
    return cut(rows.select("a", "b", "size_a", "size_b", "tokens_a", "tokens_b").mapInArrow(keep("tokens", overlap), schema).select("a", "b"), "links")


def labelled(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """The matrix: entries with their groups, of the tokens that several groups have, with the token's nodes ``n``, its largest
    group ``top`` and how many pairs of nodes of different groups it has."""
    rows = entries.join(groups, F.col("node") == F.col("member"), "left").select("token", "node", "size", "times", "low", "high", F.coalesce("component", "node").alias("grp"))
    rows = cut(rows, "labelled")
    each = rows.groupBy("token", "grp").agg(F.count(F.lit(1)).alias("k"))
    lists = each.groupBy("token").agg(F.sum("k").alias("n"), F.max_by("grp", F.struct("k", "grp")).alias("top"), F.max("k").alias("most"), ((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("pairs"))
    return rows.join(lookup(lists.filter("pairs > 0"), "lists"), "token")


def across(matrix_rows: DataFrame, long: DataFrame, parts: int) -> DataFrame:
    """(a, b) of different groups that share a token of a short list, whose sizes fit, and of which a, the smaller one, qualifies as a query for the
    group of b. ``long``: (query, more), the number of each node's tokens in long lists."""
    rows = matrix_rows.select("token", "node", "size", "times", "grp").withColumn("p", F.pmod(F.xxhash64("token"), F.lit(parts)).cast("int"))

    def task(table):
        import pyarrow as pa

        token, node, size, times, grp = (table.column(c).to_numpy() for c in ("token", "node", "size", "times", "grp"))
        order = np.lexsort((node, size, token))
        token, node, size, times, grp = token[order], node[order], size[order], times[order], grp[order]
        ends = np.searchsorted(token, token, "right")
        x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # each entry meets, step by step, the next ones of its token that are not too large
        live, step = np.arange(len(token)), 1
        while len(live):
            live = live[live + step < ends[live]]
            live = live[100 * size[live] >= PERCENT * size[live + step]]
            apart = live[grp[live] != grp[live + step]]
            x.append(apart)
            y.append(apart + step)
            step += 1
        x, y = np.concatenate(x), np.concatenate(y)
        # the unions: a token counts once for a query and a group
        order = np.lexsort((size[y], grp[y], x))
        x, y = x[order], y[order]
        one = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (grp[y[1:]] != grp[y[:-1]]))) if len(x) else np.zeros(0, np.int64)
        last = np.append(one[1:], len(x)) - 1
        met = np.stack([node[x[one]], grp[y[one]], size[x[one]], times[x[one]], size[y[one]], size[y[last]]], axis=1)
        met = met[np.lexsort((met[:, 1], met[:, 0]))]
        new = np.flatnonzero(np.append(True, np.any(met[1:, :2] != met[:-1, :2], axis=1))) if len(met) else np.zeros(0, np.int64)
        if len(new):
            met = np.stack([met[new, 0], met[new, 1], met[new, 2], np.add.reduceat(met[:, 3], new), np.minimum.reduceat(met[:, 4], new), np.maximum.reduceat(met[:, 5], new)], axis=1)
        pairs = np.unique(np.stack([node[x], grp[y], node[y]], axis=1), axis=0) if len(x) else np.zeros((0, 3), np.int64)
        none = np.zeros(len(pairs), np.int64)
        columns = [np.concatenate([met[:, 0], pairs[:, 0]]), np.concatenate([met[:, 1], pairs[:, 1]]), np.concatenate([np.full(len(met), -1), pairs[:, 2]]), *[np.concatenate([met[:, k], none]) for k in range(2, 6)]]
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=["query", "grp", "member", "size", "shared", "low", "high"])

    found = cut(rows.groupBy("p").applyInArrow(task, "query long, grp long, member long, size long, shared long, low long, high long"), "across")
    bound = found.filter("member < 0").groupBy("query", "grp", "size").agg(F.sum("shared").alias("shared"), F.min("low").alias("low"), F.max("high").alias("high")).join(long, "query", "left")
    opens = bound.filter(F.col("shared") + F.coalesce("more", F.lit(0)) >= least_shared("size", "low", "high"))
    pairs = found.filter("member >= 0").join(lookup(opens.select("query", "grp"), "opens"), ["query", "grp"], "left_semi")
    return pairs.select(F.least("query", "member").alias("a"), F.greatest("query", "member").alias("b"))


def opened(matrix_rows: DataFrame, texts: DataFrame, key: bytes) -> DataFrame:
    """Links of the long lists: the nodes outside a list's largest group are its queries, and its groups are opened for
    them, in blocks of at most about ``OPEN`` nodes on each side. A query gives one link for each group that it reaches."""
    rows = matrix_rows.select("token", "node", "size", "grp", (F.col("grp") != F.col("top")).alias("asks"), F.ceil(F.col("n") / OPEN).cast("int").alias("m"), F.greatest(F.ceil((F.col("n") - F.col("most")) / OPEN), F.lit(1)).cast("int").alias("q"))
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = rows.withColumn("mb", block("m")).withColumn("qb", every("q")).withColumn("asks", F.lit(False))
    queries = rows.filter("asks").withColumn("qb", block("q")).withColumn("mb", every("m"))
    columns = ("token", "qb", "mb", "node", "size", "grp", "asks")
    both = members.select(*columns).unionByName(queries.select(*columns))
    known = cut(sets(texts, rows.select("node").distinct(), key), "sets")

    def task(table):
        import pyarrow as pa

        node, size, grp, asks = (table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "size", "grp", "asks"))
        bodies = [np.frombuffer(x, U64) for x in windows.blobs(table.column("tokens"))]
        lengths = np.array([len(x) for x in bodies])
        names, at = np.unique(np.concatenate(bodies), return_inverse=True)
        row = np.repeat(np.arange(len(bodies)), lengths)
        wide = np.bincount(at, minlength=len(names)) > 1
        place = np.cumsum(wide) - 1
        row, at = row[wide[at]], place[at[wide[at]]]
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        ask, have = np.flatnonzero(asks), np.flatnonzero(~asks)
        have = have[np.argsort(grp[have], kind="stable")]
        found, begin = np.unique(grp[have], return_index=True)

        def shared(of: np.ndarray, with_: np.ndarray, unions: np.ndarray | None = None) -> np.ndarray:
            """How many tokens each of some rows shares with each of others, or with the unions of others that begin at ``unions``."""
            out = np.zeros((len(of), len(with_ if unions is None else unions)), np.float32)  # counts below 2**24 are exact
            for first in range(0, int(wide.sum()), 2048):
                lo, hi = np.searchsorted(at, [first, first + 2048])
                part = np.zeros((len(bodies), 2048), np.float32)
                part[row[lo:hi], at[lo:hi] - first] = 1
                right = part[with_] if unions is None else np.maximum.reduceat(part[with_], unions, axis=0)
                out += part[of] @ right.T
            return out.astype(np.int64)

        if not len(ask) or not len(have):
            return pa.table([pa.array([], pa.int64())] * 2, names=["a", "b"])
        least = np.minimum.reduceat(size[have], begin)
        smallest = np.maximum(least[None, :], -(-PERCENT * size[ask][:, None] // 100))  # the smallest member that a query can link with
        reach = (100 + PERCENT) * shared(ask, have, begin) >= PERCENT * (size[ask][:, None] + smallest)
        reach &= grp[ask][:, None] != found[None, :]
        have = have[reach.any(axis=0)[np.searchsorted(found, grp[have])]]
        x, y = np.nonzero(similar(shared(ask, have), size[ask][:, None], size[have][None, :]) & reach[:, np.searchsorted(found, grp[have])])
        a, b = ask[x], have[y]
        _, one = np.unique(np.stack([node[a], grp[b]], axis=1), axis=0, return_index=True)
        return pa.table([pa.array(node[a[one]]), pa.array(node[b[one]])], names=["a", "b"])

    return cut(both.join(known, "node").groupBy("token", "qb", "mb").applyInArrow(task, "a long, b long"), "links")


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(members, nodes): (doc_id, node) for every row of ``docs``; (node, n_shingles, component) for every different text."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    filter_of = exact.text_filter(rows)
    texts = cut(exact.distinct_texts(rows, filter_of), "texts")
    members = cut(exact.members(rows, texts, filter_of), "members")
    texts = texts.select("node", "text")
    key = windows.new_key()
    found = matrix(texts, sketch(texts, key), key)
    entries = cut(possible(found), "entries")
    nodes = found.filter("kind = 2").select(F.col("x").alias("node"), F.col("y").alias("size"), "histogram")
    able = lookup(entries.select(F.col("node").alias("able")).distinct(), "able")
    near = found.filter("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b"))
    for side in "ab":
        near = near.join(able, F.col(side) == F.col("able"), "left_semi")
    near = verify(near, nodes, texts, key)
    groups = lookup(components(near).withColumnRenamed("node", "member"), "groups")
    rows = cut(labelled(entries, groups), "rows")
    wide = rows.filter(F.col("pairs") > LISTED)
    long = lookup(wide.groupBy("node", "size").agg(F.sum("times").alias("more"), F.min("low").alias("low"), F.max("high").alias("high")), "long")
    far = verify(across(rows.filter(F.col("pairs") <= LISTED), long.select(F.col("node").alias("query"), "more"), 2 * spread(texts)), nodes, texts, key)
    enough = long.filter(F.col("more") >= least_shared("size", "low", "high")).select("node")
    wide = opened(wide.join(enough, "node", "left_semi"), texts, key)
    linked = lookup(components(near.unionByName(far).unionByName(wide)), "components")
    return members, nodes.join(linked, "node", "left").select("node", F.col("size").alias("n_shingles"), F.coalesce("component", "node").alias("component"))


def components_of(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    members, nodes = join(docs)
    nodes = cut(nodes, "nodes")
    least = members.groupBy("node").agg(F.min("doc_id").alias("least"))
    ids = nodes.join(least, "node").groupBy("component").agg(F.min("least").alias("component_id"))
    table = lookup(nodes.join(ids, "component").select("node", "n_shingles", "component_id"), "answers")
    out = members.join(table, "node")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, that stay when of each component only the smallest id stays. Of rows that
    share that id, all with its text stay; documents without a word all stay."""
    found = components_of(docs.select("doc_id", "text")).filter("doc_id <=> component_id").select("doc_id").distinct()
    rows = packed(docs).join(lookup(found.withColumnRenamed("doc_id", "kept"), "kept"), F.col("row.doc_id").eqNullSafe(F.col("kept")), "left_semi")
    return rows.select("row.*")
