"""Best-fit packing of token sequences by bin completion.

What has to be packed is only a histogram: how many pieces have each length from 1 to the capacity. Spark counts it (at
most ``capacity`` rows reach the driver, whatever the input), bin completion plans bins on it, and Spark deals the
pieces to the planned places.

The plan: take the largest length that is left; enumerate the undominated fillings of what remains of its
bin (if one piece fills it exactly, every other filling is dominated by that one), exact ones first; use a
filling for as many bins as its lengths last, or for fewer when all that has been tried; go on. This is a depth-first branch
and bound over fillings, all of which it would reach: a branch ends when its waste so far already costs as many bins as the best
plan known (at first best-fit decreasing).

The order of the fillings decides how soon a good plan is found. Exact fillings first is quick and does best where pieces are many. Where they
are few, it spends several small pieces on bins that one would nearly fill, and later bins lack them: so the search is repeated
with a price for each piece, in units of waste, and the filling of the least waste and price goes first (a shortest path over the room).

A search ends when a plan meets the lower bound, or after ``nodes`` steps for each different length (counted as 1000 at least; a tenth of
that for searches with a price) without a better plan; that is its only limit.

The deal: a piece is the r-th of its length, counted over hash buckets so that no length gathers in one task; the plan,
a table of runs (length, from rank -> bin, offset), tells its bin and offset.

Defined cases: a null or empty text is the end id alone; rows that share an id are packed each; a document longer than the
capacity is cut into full pieces, the first of which may be shorter; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .env import cut, ready, spread

CAPACITY, NODES = 1024, 20
#: Prices of a piece, in the order in which searches use them.
PRICES = (None, 12, 16, 32, 8)


def lower_bound(counts: np.ndarray) -> int:
    """Bins that any packing needs: by total size, and by the pieces too large to share a bin (for each threshold)."""
    cap, sizes = len(counts) - 1, np.arange(len(counts))
    best = -(-int((counts * sizes).sum()) // cap)
    for t in range(1, cap // 2 + 1):
        large, middle = counts[cap - t + 1 :].sum(), counts[cap // 2 + 1 : cap - t + 1].sum()
        free = int((counts[cap // 2 + 1 : cap - t + 1] * (cap - sizes[cap // 2 + 1 : cap - t + 1])).sum())
        need = int((counts[t : cap // 2 + 1] * sizes[t : cap // 2 + 1]).sum()) - free
        best = max(best, int(large + middle) + max(0, -(-need // cap)))
    return best


def best_fit(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: [(lengths of a bin, number of such bins)]."""
    cap, opened = len(counts) - 1, {}
    for size in range(cap, 0, -1):
        left = int(counts[size])
        while left:
            room = next((r for r in range(size, cap) if opened.get(r)), None)
            if room is None:
                each = cap // size
                if full := left // each:
                    opened.setdefault(cap - size * each, []).append(((size,) * each, full))
                if left % each:
                    opened.setdefault(cap - size * (left % each), []).append(((size,) * (left % each), 1))
                left = 0
                continue
            have, n = opened[room].pop()
            use = min(n, left)
            if n > use:
                opened[room].append((have, n - use))
            opened.setdefault(room - size, []).append((have + (size,), use))
            left -= use
    return [x for same in opened.values() for x in same]


def greedy(have: np.ndarray, x: int, room: int) -> tuple[tuple[int, ...], int]:
    """A filling with a piece of length ``x``, then the largest pieces until two fill it exactly or nothing fits: (lengths, room left)."""
    mine, parts, rest = have.copy(), [x], room - x
    mine[x] -= 1
    while rest > 0:
        rests = np.flatnonzero(mine[1 : rest + 1]) + 1
        if not len(rests):
            break
        y = int(rests[-1])
        if y < rest <= 2 * y:  # two pieces that end the bin exactly, if there are
            pair = rests[(mine[rest - rests] > (rests * 2 == rest)) & (rests * 2 >= rest)]
            if len(pair):
                return (*parts, int(pair[-1]), rest - int(pair[-1])), 0
        n = max(1, min(int(mine[y]), rest // y - 1))
        mine[y] -= n
        parts += [y] * n
        rest -= y * n
    return tuple(parts), rest


def cheapest(have: np.ndarray, room: int, price: float) -> tuple[int, ...]:
    """The filling with the least waste and price of its pieces, to which no piece that is left can be added."""
    sizes = np.flatnonzero(have[1 : room + 1])[::-1] + 1
    cost, taken = np.full(room + 1, np.inf), []
    cost[0] = 0
    for x in sizes.tolist():
        for _ in range(min(int(have[x]), room // x)):
            other = cost[: room + 1 - x] + price
            better = other < cost[x:]
            if not better.any():
                break
            cost = np.concatenate([cost[:x], np.where(better, other, cost[x:])])
            taken.append((x, better))
    waste = room - np.arange(room + 1)
    at, parts = int(np.flatnonzero(cost + waste == (cost + waste).min())[-1]), []
    rest = room - at
    for x, better in reversed(taken):
        if at >= x and better[at - x]:
            parts.append(x)
            at -= x
    mine = have.copy()
    np.subtract.at(mine, parts, 1)
    while len(more := np.flatnonzero(mine[1 : rest + 1])):
        parts.append(int(more[-1]) + 1)
        mine[parts[-1]] -= 1
        rest -= parts[-1]
    return tuple(sorted(parts, reverse=True))


def maximal(have: np.ndarray, room: int) -> Iterator[tuple[int, ...] | None]:
    """All fillings to which no piece that is left can be added, and None for each step that found none."""
    sizes = np.flatnonzero(have[: room + 1])[::-1]
    many = have[sizes]
    left = [*np.cumsum((sizes * many)[::-1])[::-1].tolist(), 0]
    sizes, many = sizes.tolist(), many.tolist()
    stack = [(0, room, (), room + 1)]  # next length, room, lengths so far, the smallest length that some were left out of
    while stack:
        i, rest, parts, least = stack.pop()
        while i < len(sizes) and sizes[i] > rest:
            i += 1
        if rest - left[i] >= least:  # a piece that was left out will fit
            yield None
        elif i == len(sizes):
            yield parts
        else:
            for n in range(min(many[i], rest // sizes[i]) + 1):
                stack.append((i + 1, rest - n * sizes[i], parts + (sizes[i],) * n, least if n == many[i] else sizes[i]))
            yield None


def fillings(counts: np.ndarray, first: int, price: float | None = None) -> Iterator[tuple[int, ...] | None]:
    """All undominated ways to fill the bin that holds ``first``, found one by one: the cheapest if there is a price, exact pairs, a greedy
    one from each length (exact ones at once, the others by waste), then the rest. ``counts`` still has that piece; None is a step that found none."""
    room = len(counts) - 1 - first
    have = counts.copy()
    have[first] -= 1
    given = set()
    if price is not None:
        given.add(cheapest(have, room, price))
        yield from given
    x = np.flatnonzero(have[: room + 1])[::-1]
    for y in x[(x * 2 >= room) & (have[room - x] > (x * 2 == room))].tolist():
        if (y, room - y) not in given:
            given.add((y, room - y))
            yield y, room - y
    later = []
    for y in x.tolist():
        parts, rest = greedy(have, y, room)
        parts = tuple(sorted(parts, reverse=True))
        if parts in given:
            continue
        given.add(parts)
        if rest:
            later.append((rest, len(parts), tuple(-z for z in parts), parts))
        yield None if rest else parts
    for *_, parts in sorted(later):
        yield parts
    for parts in maximal(have, room):
        yield None if parts in given else parts


def steps_of(counts: np.ndarray, price: float | None = None) -> Iterator[tuple[tuple[int, ...], int] | None]:
    """What can be done with the largest length that is left: (lengths of a bin, number of bins), as many bins as its lengths last
    first; None is a step that found nothing."""
    first = int(np.flatnonzero(counts)[-1])
    room = len(counts) - 1 - first

    def times(filling: tuple[int, ...]) -> int:
        size, need = np.unique((first, *filling), return_counts=True)
        return int((counts[size] // need).min())

    own = counts[first] - 1 if room >= first else 0
    if not counts[1 : room + 1].any() or (room == first and not own and not counts[1:room].any()):
        yield (first,), int(counts[first])
        return
    if room and (own if room == first else counts[room]):  # dominates every other filling
        yield (first, room), times((room,))
        return
    for f in fillings(counts, first, price):
        yield f if f is None else ((first, *f), times(f))
    for f in fillings(counts, first, price):
        yield None
        if f is not None:
            for n in range(times(f) - 1, 0, -1):
                yield (first, *f), n


def search(counts: np.ndarray, used: int, bound: int, quota: int, price: float | None) -> tuple[list, int] | None:
    """The best plan with fewer than ``used`` bins that is found, and its number of bins."""
    cap, total = len(counts) - 1, int((counts * np.arange(len(counts))).sum())
    best, left = None, quota
    # a node: (histogram, bins so far, waste so far, the steps that led here, what can be done next)
    stack = [(counts.copy(), 0, 0, None, None)]
    while stack and used > bound and left > 0:
        have, bins, waste, steps, options = stack[-1]
        if -(-(total + waste) // cap) >= used:
            stack.pop()
            continue
        if options is None:
            if not have.any():
                best, used, left = [], bins, quota
                while steps:
                    best.append(steps[0])
                    steps = steps[1]
                stack.pop()
                continue
            options = steps_of(have, price)
            stack[-1] = (have, bins, waste, steps, options)
        left -= 1
        step = next(options, stack)
        if step is stack:
            stack.pop()
        elif step is not None:
            lengths, times = step
            after = have.copy()
            size, need = np.unique(lengths, return_counts=True)
            after[size] -= need * times
            stack.append((after, bins + times, waste + times * (cap - sum(lengths)), (step, steps), None))
    return None if best is None else (best, used)


def plan(counts: np.ndarray, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Bins for a histogram (index = length, the last index is the capacity): [(lengths, number of such bins)]."""
    counts = np.asarray(counts, np.int64)
    bound, best = lower_bound(counts), best_fit(counts)
    used, quota = sum(n for _, n in best), nodes * max(1000, np.count_nonzero(counts))
    for price in PRICES:
        if used > bound and (found := search(counts, used, bound, quota if price is None else quota // 10, price)):
            best, used = found
    return best


def places(bins: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """The plan by piece: for each run of ranks of a length (key, sorted): its bins' first number, pieces in a bin, first offset."""
    runs, taken, base = [], {}, 0
    for lengths, n in bins:
        at = 0
        for size in sorted(set(lengths), reverse=True):
            each = lengths.count(size)
            runs.append(((size << 44) + taken.get(size, 0), base, each, at))
            taken[size] = taken.get(size, 0) + each * n
            at += each * size
        base += n
    return tuple(np.array(x, np.int64) for x in zip(*sorted(runs))) if runs else (np.zeros(0, np.int64),) * 4


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of the pieces of every document."""
    ready(docs.sparkSession)
    path = path or tokens.default_path()

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = tokens.encoder(path).encode
        for batch in batches:
            out = []
            for one, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(body.as_py())
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    to = at + (n - at) % capacity if (n - at) % capacity else at + capacity
                    out.append((one, k, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                    at, k = to, k + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(task, "doc_id long, piece int, start long, length long, ids_crc32 long")


def deal(cut_pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """``cut_pieces`` with sequence_id and offset."""
    buckets = spread(cut_pieces, 4 << 20)
    rows = cut_pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    by_bucket = rows.groupBy("length", "_b").count()
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in by_bucket.groupBy("length").agg(F.sum("count")).collect():  # at most ``capacity`` rows
        counts[size] = n
    key, base, each, at = places(plan(counts, nodes))
    order = W.partitionBy("length").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    before = by_bucket.withColumn("_before", F.coalesce(F.sum("count").over(order), F.lit(0))).drop("count")
    rank = F.row_number().over(W.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = rows.withColumn("_rank", rank).join(before, ["length", "_b"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_rank")).cast("long").alias("_rank"))

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            size, r = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            mine = (size << 44) + r
            run = np.searchsorted(key, mine, "right") - 1
            nth = mine - key[run]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(base[run] + nth // each[run]), pa.array(at[run] + nth % each[run] * size)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(task, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of ``docs`` and their places in sequences of at most ``capacity`` ids."""
    return deal(cut(pieces(docs, path, capacity), "pieces"), capacity)
