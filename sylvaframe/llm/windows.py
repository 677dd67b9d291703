"""Repeated windows of K units (bytes or words) over a whole table, as Spark jobs.

Every window has a minimizer: the k-gram inside it with the smallest hash. Windows with equal content have the same
minimizer, so runs of windows that share one ("contexts") can be compared by minimizer, and a context whose minimizer occurs
only once in the table holds no repeated window. A minimizer that ``HOT`` different places have is split: each of its windows
is a context by itself and goes to one of as many parts as the places need, told by the window's own hash, so that equal windows still
meet and no part has all of them.

Two kinds of hash are used. Sums of powers (``run_hash``) are quick to roll over a text but may be equal for texts that are made for it, so
they only choose minimizers and parts: two grams with one sum meet in a part and are compared there. What decides that two words or two
contexts are the same are ``byte_hash`` and ``chained``, which pass the content itself, 8 bytes or a word at a time, through a function with a secret key that
each run of an operator draws anew (``new_key``): texts can't be made to collide beforehand, and by chance two of n contents do with n * n / 2**65.

The jobs:

1. Each task takes the minimizers' fingerprints of its documents and sends them, 8 bytes each, to their part. Those that it has met ``OFTEN`` times are summed up
   before, in groups of few blocks: of a fingerprint that every document has, a part gets one entry for each block.
2. Each part finds the fingerprints that occur more than once, and those to be split, and tells the blocks of documents that
   have them.
3. Each block sends the contexts of those fingerprints to their part, each different one once, so that copies within
   a block do not travel and a hot context reaches its part at most once from each block.
4. Each part compares its contexts with the operator's own method and answers, for every context asked about, what of it
   is repeated.
5. Each block applies the answers to its documents.

A context takes several times the bytes of text that are its own, as neighbours overlap. ``screen`` puts a step before 3, so that copies are not sent: each block
tells its contexts by their hashes and places; each part finds the earliest of each kind, and whether its minimizer has contexts of another kind. Only then can
one of its windows be equal to another's, and only the earliest is sent. A context that is not the earliest of its kind is repeated as a whole.

A block is a hash range of document ids, and for words of ids and texts; blocks and parts grow in number with the input, and no step holds more than
one of them. Long documents are handled in overlapping segments. The text is shuffled once (3 and 5 share the exchange), with ``screen`` twice, one after the other:
a table that is cut gives back its shuffle files then.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable, Iterator
from contextlib import nullcontext
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .env import cut, freeing, ready, spread

U64 = np.uint64
CHUNK = 1 << 20
#: Held fingerprints after which a task of step 1 sends them on.
HELD = 1 << 22
#: Bytes of input for each block and each part; small tables have as many of both as there are shuffle partitions.
BLOCK_BYTES, PART_BYTES = 2 << 20, 4 << 20
#: Times that a task of step 1 tells a fingerprint of one block, at most.
TOLD = 16
#: Entries of one fingerprint in one message from which they are summed up by blocks first, and the blocks of one such sum.
OFTEN, SUMMED_BLOCKS = 64, 64
#: Marks rows about a block's contexts: this less the part's number.
SAID = -3
#: Fingerprints told from which a minimizer is split, into two parts for each so many.
HOT = 1 << 12


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> U64(32))) * U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(29))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


#: Offset and multipliers of ``keyed``, set by ``seal``; these are used where no key was given.
KEY = {"offset": U64(0x8CB92BA72F3D8DD7), "first": U64(0xE7037ED1A0B428DB), "second": U64(0xA0761D6478BD642F), "long": b"long"}


def new_key() -> bytes:
    """A key for one run of an operator: made by the driver, carried by its tasks."""
    return secrets.token_bytes(32)


def seal(key: bytes) -> None:
    """Every task begins with this: the worker's hashes are those of the run's key."""
    for name in ("offset", "first", "second"):
        KEY[name] = U64(int.from_bytes(hashlib.blake2b(name.encode(), key=key, digest_size=8).digest(), "little") | 1)
    KEY["long"] = key


def keyed(x: np.ndarray) -> np.ndarray:
    """A bijection that scatters, unknown to whoever wrote the texts."""
    x = (x ^ (x >> U64(32))) * KEY["first"]
    x = (x ^ (x >> U64(29))) * KEY["second"]
    return x ^ (x >> U64(32))


BYTE_CODE = mix(np.arange(1, 257, dtype=U64))
BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**j and BASE**-j modulo 2**64 for j < n."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, base, U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences, scaled back, are hashes of runs of ``values``."""
    p = powers(1 << max(20, int(len(values) + 1).bit_length()))[0]
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * p[: len(values)], out=out[1:])
    return out


def run_hash(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of values[a:b], for arrays of a and b."""
    back = powers(1 << max(20, int(len(prefix)).bit_length()))[1]
    return mix((prefix[b] - prefix[a]) * back[a])


def chained(values: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of values[first : first + n], for arrays of both; each value scatters what came before it."""
    out = keyed(n.astype(U64) + KEY["offset"])
    live, shortest = np.arange(len(n)), int(n.min()) if len(n) else 0
    for j in range(int(n.max()) if len(n) else 0):
        if j < shortest:
            out = keyed(out ^ values[first + j])
        else:
            live = live[n[live] > j]
            out[live] = keyed(out[live] ^ values[first[live] + j])
    return out


def rolled(values: np.ndarray, K: int) -> np.ndarray:
    """A hash of each K values that follow one another, made of those of halves."""
    out, size = keyed(values ^ KEY["offset"]), 1
    while size < K:
        step = min(size, K - size)
        out = keyed((out[:-step] * U64(0x9FB21C651E98DF25)) ^ out[step:])
        size += step
    return out


#: Runs of more bytes are hashed one by one.
LONG_RUN = 1024


def byte_hash(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of data[first:last], for arrays of both: eight bytes at a time, each of which scatters what came before."""
    n = last - first
    eights = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))
    out = keyed(n.astype(U64) * U64(3) + KEY["offset"])
    live = np.flatnonzero((n > 0) & (n <= LONG_RUN))
    for j in range(0, LONG_RUN, 8):
        if not len(live):
            break
        rest = n[live] - j
        x = eights[first[live] + j]
        short = rest < 8
        if short.any():
            x = np.where(short, x & ((U64(1) << (U64(8) * np.minimum(rest, 7).astype(U64))) - U64(1)), x)
        out[live] = keyed(out[live] ^ x)
        live = live[rest > 8]
    for i in np.flatnonzero(n > LONG_RUN):
        out[i] = int.from_bytes(hashlib.blake2b(data[first[i] : last[i]], digest_size=8, key=KEY["long"]).digest(), "little")
    return out


class Contexts:
    """Runs of windows by minimizer: of unit positions [first, last + K) with windows starting at first..last. ``fp``: the minimizer's
    fingerprint; ``whole``: a hash of the content."""

    def __init__(self, first, last, fp, whole):
        self.first, self.last, self.fp, self.whole = first, last, fp, whole


def contexts(values: np.ndarray, bounds: np.ndarray, K: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, fp) of a chunk of units in which documents (or segments) lie between ``bounds``."""
    n, w = len(values), K - k + 1
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    if n < K:
        return none
    prefix = sums(values)
    a = np.arange(n - k + 1)
    gram = run_hash(prefix, a, a + k)
    key = (gram & U64(0xFFFFFFFF00000000)) | a.astype(U64)
    size = 1
    while size * 2 <= w:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    starts = n - K + 1
    least = np.minimum(key[:starts], key[w - size : w - size + starts]) & U64(0xFFFFFFFF)
    ok = np.zeros(starts + 1, np.int32)
    lo, hi = bounds[:-1], np.diff(bounds) - K + 1
    lo, hi = lo[hi > 0], (lo + hi)[hi > 0]
    ok[lo] += 1
    ok[hi] -= 1
    valid = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
    if not len(valid):
        return none
    least = least[valid].astype(np.int64)
    new = np.ones(len(valid), bool)
    new[1:] = (valid[1:] != valid[:-1] + 1) | (least[1:] != least[:-1])
    new |= np.isin(valid, lo)
    at = np.flatnonzero(new)
    return valid[at], valid[np.append(at[1:], len(valid)) - 1], gram[least[at]]


def member(fp: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of ``fp`` are in ``of``, which is sorted."""
    return of[np.minimum(np.searchsorted(of, fp), len(of) - 1)] == fp if len(of) else np.zeros(len(fp), bool)


class Block:
    """Documents of one table as units, in ascending (id, text) order. ``kind``: 'bytes' or 'words'."""

    def __init__(self, table, kind: str):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.select(["doc_id", "text"])
        order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start")
        self.order = order.to_numpy()
        table = table.take(order).combine_chunks()
        text = pc.fill_null(table.column("text"), "").cast(pa.large_binary()).combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        ids = table.column("doc_id")
        self.doc_ids, self.null = ids.fill_null(np.iinfo(np.int64).min).to_numpy(), ids.is_null().to_numpy()
        offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, 8 * text.offset) if len(text) else np.zeros(1, np.int64)
        self.data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(text) and text.buffers()[2] else np.zeros(0, np.uint8)
        self.byte_at = offsets - offsets[0]
        self.kind = kind
        if kind == "words":
            self.hashes, self.at = words(self.data, self.byte_at)
        else:
            self.at = self.byte_at

    def __len__(self) -> int:
        return len(self.doc_ids)

    def values(self, a: int, b: int) -> np.ndarray:
        return self.hashes[a:b] if self.kind == "words" else BYTE_CODE[self.data[a:b]]

    def chunks(self, K: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first unit, bounds from there): whole documents, or overlapping segments of one that is long."""
        k, most = 0, CHUNK // 2 if self.kind == "bytes" else CHUNK
        while k < len(self):
            to = int(np.searchsorted(self.at, self.at[k] + most, "right")) - 1
            if to > k:
                yield int(self.at[k]), self.at[k : to + 1] - self.at[k]
                k = to
                continue
            a, end = int(self.at[k]), int(self.at[k + 1])
            while True:
                b = min(end, a + most)
                yield a, np.array([0, b - a])
                if b == end:
                    break
                a = b - K + 1
            k += 1

    def content(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A hash of the units first..last-1."""
        return chained(self.hashes, first, last - first) if self.kind == "words" else byte_hash(self.data, first, last)

    def contexts(self, K: int, k: int, only: np.ndarray | None = None, hot: tuple[np.ndarray, np.ndarray] | None = None) -> Contexts:
        """Over all documents, in order. Of the fingerprints ``only``, sorted, if given, and then with the hash of the content; of these the
        fingerprints in ``hot`` (sorted, with the number of parts of each) are split."""
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64))
        parts = [none]
        for a, bounds in self.chunks(K):
            first, last, fp = contexts(self.values(a, a + int(bounds[-1])), bounds, K, k)
            if only is not None:
                keep = member(fp, only)
                first, last, fp = first[keep], last[keep], fp[keep]
            parts.append((first + a, last + a, fp))
        first, last, fp = (np.concatenate(x) for x in zip(*parts))
        if only is None:
            return Contexts(first, last, fp, fp)
        c = Contexts(first, last, fp, self.content(first, last + K))
        of = member(fp, hot[0])
        if not of.any():
            return c
        n = (last - first + 1)[of]
        at = np.repeat(first[of] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        whole = self.content(at, at + K)
        own = np.repeat(fp[of], n)
        own = mix(own ^ mix(whole % hot[1][np.searchsorted(hot[0], own)] + U64(1)))
        columns = zip((first[~of], last[~of], fp[~of], c.whole[~of]), (at, at, own, whole))
        first, last, fp, whole = (np.concatenate(x) for x in columns)
        order = np.argsort(first, kind="stable")
        return Contexts(first[order], last[order], fp[order], whole[order])


def words(data: np.ndarray, byte_at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word ``[^\\x20\\x09-\\x0D]+`` of the documents that lie between ``byte_at``, and each document's first
    word. ``lower``: A-Z count as a-z."""
    hashes, at = [], np.zeros(len(byte_at), np.int64)
    k, total = 0, 0
    while k < len(byte_at) - 1:
        to = max(k + 1, int(np.searchsorted(byte_at, byte_at[k] + CHUNK, "right")) - 1)
        a, b = int(byte_at[k]), int(byte_at[to])
        d = data[a:b]
        if lower:
            d = d + ((d >= 65) & (d <= 90)).astype(np.uint8) * np.uint8(32)
        inside = np.zeros(len(d) + 2, np.int8)
        inside[1:-1] = ~((d == 32) | ((d >= 9) & (d <= 13)))
        edge = np.diff(inside)
        cuts = byte_at[k + 1 : to] - a  # a word ends with its document
        cuts = cuts[(cuts > 0) & (cuts < len(d))]
        cuts = np.unique(cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)])
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(cuts):
            first, last = np.sort(np.concatenate([first, cuts])), np.sort(np.concatenate([last, cuts]))
        if len(first):
            hashes.append(byte_hash(d, first, last))
        at[k + 1 : to + 1] = total + np.searchsorted(first, byte_at[k + 1 : to + 1] - a, "left")
        total += len(first)
        k = to
    return (np.concatenate(hashes) if hashes else np.zeros(0, U64)), at


def unique(c: Contexts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal contexts: (the first of each kind, each context's kind, how many of each kind). Kinds are sorted by (fp, whole)."""
    order = np.lexsort((c.whole, c.fp))
    new = np.ones(len(order), bool)
    new[1:] = (c.fp[order[1:]] != c.fp[order[:-1]]) | (c.whole[order[1:]] != c.whole[order[:-1]])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return order[starts], kind, np.diff(np.append(starts, len(order)))


def part_of(fp: np.ndarray, parts: int) -> np.ndarray:
    return (mix(fp ^ U64(0x5851F42D4C957F2D)) >> U64(16)) % U64(parts)


def by_part(fp: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    p = part_of(fp, parts).astype(np.int64)
    order = np.argsort(p, kind="stable")
    cuts = np.flatnonzero(np.diff(p[order], prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(order))):
        yield int(p[order[a]]), order[a:b]


def tidy() -> None:
    """Gives back what the group before has freed: allocators keep it, and a worker lives as long as its executor."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library than glibc
        pass


def told(fp: np.ndarray, b: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (fingerprint, block, how many times) with each pair once."""
    order = np.lexsort((b, fp))
    fp, b, times = fp[order], b[order], times[order]
    new = np.flatnonzero(np.append(True, (fp[1:] != fp[:-1]) | (b[1:] != b[:-1]))) if len(fp) else np.zeros(0, np.int64)
    return fp[new], b[new], np.add.reduceat(times, new) if len(new) else times[:0]


def blobs(column) -> list[bytes]:
    return [x.as_py() for x in column]


def flags_to_bytes(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def planes(x: np.ndarray) -> bytes:
    """Numbers as all their first bytes, all their second bytes and so on: those of small ones are mostly zeros, which a shuffle compresses."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def from_planes(data: list[bytes], dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    parts = [np.frombuffer(x, np.uint8).reshape(size, -1).T for x in data]
    return np.ascontiguousarray(np.concatenate([np.zeros((0, size), np.uint8), *parts])).view(dtype).ravel()


def screened(tag: np.ndarray, whole: np.ndarray, place: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts with part of their minimizer's fingerprint, a hash of the content and a place (the most significant number first): those that are not
    the earliest of their kind, and those that are while their fingerprint has another kind."""
    order = np.lexsort((*place[::-1], whole, tag))
    tag, whole = tag[order], whole[order]
    other = np.append(True, tag[1:] != tag[:-1])[: len(tag)]
    new = other | np.append(True, whole[1:] != whole[:-1])[: len(tag)]
    several = np.add.reduceat(new, np.flatnonzero(other), dtype=np.int64) > 1 if len(tag) else new
    later, asked = np.zeros(len(tag), bool), np.zeros(len(tag), bool)
    later[order] = ~new
    asked[order] = new & np.repeat(several, np.diff(np.append(np.flatnonzero(other), len(tag))))
    return later, asked


def find(docs: DataFrame, kind: str, K: int, k: int, ask: Callable, answer: Callable, apply: Callable, schema: str, text: str = "text", doc_id: str = "doc_id", part_bytes: int = PART_BYTES, screen: bool = False) -> DataFrame:
    """Runs the five steps. ``ask(block, contexts, first, count)`` -> columns of bytes to send, one entry a kind;
    ``answer(list of asked)`` -> list of bytes, one for each block that has asked; ``apply(block, contexts, replies)`` -> Arrow table of
    ``schema``, where ``replies`` are None or (list of (kinds, bytes), first, kind of each context, count). ``screen``: for answers that are a bit for each
    window, which is set if an equal one starts earlier; only the earliest context of a kind is asked about, if at all."""
    import pyarrow as pa

    spark = docs.sparkSession
    ready(spark)
    n_blocks, parts, hot_from, key = spread(docs, BLOCK_BYTES), spread(docs, part_bytes), HOT, new_key()
    held_most = HELD // 2 if kind == "bytes" else HELD  # a text has several times as many bytes as words
    # for bytes, rows that share an id stay together, as their order by text counts
    dealt = ("doc_id", "text") if kind == "words" else ("doc_id",)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("_b", F.pmod(F.xxhash64(*dealt), F.lit(n_blocks)).cast("int"))

    def send(batches: Iterator) -> Iterator:  # step 1
        held: list = []

        def flush() -> Iterator:
            fp, b = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((b, fp))
            fp, b = fp[order], b[order]
            more = np.zeros(len(fp), bool)
            more[TOLD:] = (fp[TOLD:] == fp[:-TOLD]) & (b[TOLD:] == b[:-TOLD])
            fp, b = fp[~more], b[~more]
            new = np.flatnonzero(np.append(True, fp[1:] != fp[:-1])) if len(fp) else np.zeros(0, np.int64)
            run = np.diff(np.append(new, len(fp)))
            often = np.repeat(run >= OFTEN, run)
            rows = [(p, -1, fp[i].tobytes(), b[i].tobytes(), None) for these in (np.flatnonzero(~often),) for p, j in by_part(fp[these], parts) for i in (these[j],)]
            for p, j in by_part(fp[often], parts):
                i = np.flatnonzero(often)[j]
                salt = b[i] // SUMMED_BLOCKS
                rows += [(p, int(x), fp[i[salt == x]].tobytes(), b[i[salt == x]].tobytes(), np.ones(int((salt == x).sum()), np.int32).tobytes()) for x in np.unique(salt)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int32(), pa.int32(), *[pa.binary()] * 3))], ["_p", "_s", "fps", "blocks", "times"])

        seal(key)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            block = Block(table, kind)
            c = block.contexts(K, k)
            b = table.column("_b").to_numpy()[block.order].astype(np.int32)
            doc = np.searchsorted(block.at, c.first, "right") - 1
            held.append((c.fp, b[doc]))
            if sum(len(x) for x, _ in held) >= held_most:
                yield from flush()
        if held:
            yield from flush()

    def entries(table):
        fp = np.frombuffer(b"".join(blobs(table.column("fps"))), U64)
        times = [np.ones(len(f) // 8, np.int64) if t is None else np.frombuffer(t, np.int32).astype(np.int64) for f, t in zip(blobs(table.column("fps")), blobs(table.column("times")))]
        return fp, np.frombuffer(b"".join(blobs(table.column("blocks"))), np.int32), np.concatenate(times) if times else np.zeros(0, np.int64)

    def summed(table):  # step 1, each part's entries by groups of blocks (those sent often) or at once (the others)
        fp, b, times = told(*entries(table))
        key = [pa.array([int(table.column(c)[0].as_py())], pa.int32()) for c in ("_p", "_s")]
        return pa.table([*key, *(pa.array([x.tobytes()], pa.binary()) for x in (fp, b, np.minimum(times, TOLD).astype(np.int32)))], names=["_p", "_s", "fps", "blocks", "times"])

    def repeated(table):  # step 2
        table = table.sort_by("_s")  # the same order in each run
        fp, b, times = entries(table)
        order = np.argsort(fp, kind="stable")
        fp, b, times = fp[order], b[order], times[order]
        new = np.flatnonzero(np.append(True, fp[1:] != fp[:-1])) if len(fp) else np.zeros(0, np.int64)
        run = np.diff(np.append(new, len(fp)))
        many = np.add.reduceat(times, new) if len(new) else times[:0]
        same = np.repeat(many > 1, run)
        fp, b = fp[same], b[same]
        among = np.repeat(2 * -(-many // hot_from), run)[same].astype(U64)  # to how many parts a minimizer goes
        hot = np.repeat(many >= hot_from, run)[same]
        rows = []
        for mark, these in ((-1, slice(None)), (-2, hot)):  # all of them, and those to be split
            f, o, s = fp[these], b[these], among[these]
            order = np.lexsort((f, o))
            f, o, s = f[order], o[order], s[order]
            once = np.append(True, (f[1:] != f[:-1]) | (o[1:] != o[:-1])) if len(f) else np.zeros(0, bool)
            f, o, s = f[once], o[once], s[once]
            cuts = np.flatnonzero(np.diff(o, prepend=-1))
            rows += [(int(o[i]), mark, (f[i:j] if mark == -1 else np.stack([f[i:j], s[i:j]], axis=1)).tobytes()) for i, j in zip(cuts, np.append(cuts[1:], len(o)))]
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["_b", "_p", "data"])

    def marked(table) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """The block's fingerprints, sorted, and those to be split, sorted, with the number of their parts."""
        masks = [b"".join(x for x, p in zip(blobs(table.column("data")), table.column("_p").to_pylist()) if p == mark) for mark in (-1, -2)]
        hot = np.frombuffer(masks[1], U64).reshape(-1, 2)
        hot = hot[np.argsort(hot[:, 0])]
        return np.sort(np.frombuffer(masks[0], U64)), (hot[:, 0], hot[:, 1])

    def tell(left, right):  # before step 3
        seal(key)
        tidy()
        rows = []
        if len(right):
            block = Block(left, kind)
            c = block.contexts(K, k, *marked(right))
            first, _, _ = unique(c)
            doc = np.searchsorted(block.at, c.first[first], "right") - 1
            of = [(c.fp[first] >> U64(32)).astype(np.uint32), c.whole[first], block.doc_ids[doc], doc.astype(np.int32), c.first[first] - block.at[doc]]
            for p, i in by_part(c.fp[first], parts):
                rows.append((p, int(left.column("_b")[0].as_py()), *(planes(x[i]) for x in of)))
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=["_p", "_b", "tags", "wholes", "ids", "docs", "starts"])

    def judge(table):  # before step 3
        table = table.sort_by("_b")
        tag, whole, *place = (from_planes(blobs(table.column(c)), t) for c, t in (("tags", np.uint32), ("wholes", U64), ("ids", np.int64), ("docs", np.int32), ("starts", np.int64)))
        later, asked = screened(tag, whole, place)
        ends = np.cumsum([len(x) // 4 for x in blobs(table.column("tags"))])
        said = [flags_to_bytes(np.concatenate([later[a:b], asked[a:b]])) for a, b in zip(np.append(0, ends[:-1]), ends)]
        return pa.table([table.column("_b").combine_chunks(), pa.array([SAID - int(table.column("_p")[0].as_py())] * len(table), pa.int32()), pa.array(said, pa.binary())], names=["_b", "_p", "data"])

    def verdicts(table) -> dict[int, np.ndarray]:
        """What each part says of a block's contexts: a row of those that are repeated as a whole, and a row of those to be asked about, filled up with zeros."""
        rows = ((SAID - p, np.unpackbits(np.frombuffer(x, np.uint8)).view(bool)) for x, p in zip(blobs(table.column("data")), table.column("_p").to_pylist()) if p <= SAID)
        return dict(rows)

    def merged(split: list, said: dict, got: dict, n: np.ndarray) -> tuple[np.ndarray, bytes]:
        """All parts' replies as one, a bit for each window, from what was said of the contexts and answered about some. ``n``: each one's windows."""
        of = np.concatenate([i for _, i in split] or [np.zeros(0, np.int64)])
        later, asked = (np.concatenate([said[p][a * len(i) : (a + 1) * len(i)] for p, i in split] or [np.zeros(0, bool)]) for a in (0, 1))
        found = np.repeat(later, n[of])
        answered = [np.unpackbits(np.frombuffer(got[p], np.uint8), count=int(n[i[said[p][len(i) : 2 * len(i)]]].sum())) for p, i in split if p in got]
        found[np.repeat(asked, n[of])] = np.concatenate([np.zeros(0, np.uint8), *answered]).astype(bool)
        return of, flags_to_bytes(found)

    def request(left, right):  # step 3
        seal(key)
        tidy()
        rows = []
        said = verdicts(right)
        if any(x.any() for x in said.values()) if screen else len(right):
            block = Block(left, kind)
            c = block.contexts(K, k, *marked(right))
            first, _, count = unique(c)
            for p, i in by_part(c.fp[first], parts):
                if screen:
                    i = i[said[p][len(i) : 2 * len(i)]]
                if len(i):
                    rows.append((p, int(left.column("_b")[0].as_py()), *ask(block, c, first[i], count[i])))
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=["_p", "_b", "keys", "sizes", "units", "more"])

    def reply(table):  # step 4
        seal(key)
        tidy()
        table = table.sort_by("_b")  # the same order in each run
        found = answer(list(zip(*(blobs(table.column(c)) for c in ("keys", "sizes", "units", "more")))))
        return pa.table([table.column("_b").combine_chunks(), pa.array([int(table.column("_p")[0].as_py())] * len(table), pa.int32()), pa.array(found, pa.binary())], names=["_b", "_p", "data"])

    def finish(left, right):  # step 5
        seal(key)
        tidy()
        if not len(left):
            return pa.table([[] for _ in out_schema], schema=out_schema)
        block = Block(left, kind)
        c, replies = None, None
        if len(right):
            c = block.contexts(K, k, *marked(right))
            first, kind_of, count = unique(c)
            got = {p: x for x, p in zip(blobs(right.column("data")), right.column("_p").to_pylist()) if p >= 0}
            split = list(by_part(c.fp[first], parts))
            replies = ([merged(split, verdicts(right), got, (c.last - c.first + 1)[first])] if screen else [(i, got[p]) for p, i in split]), first, kind_of, count
        return apply(block, c, replies)

    kinds_of = {"long": pa.int64(), "string": pa.string(), "array<struct<start:long,words:long,source:long,source_start:long>>": pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "words", "source", "source_start")]))}
    out_schema = pa.schema([(c.split()[0], kinds_of[c.split()[1]]) for c in schema.split(", ")])
    sent = docs.mapInArrow(send, "_p int, _s int, fps binary, blocks binary, times binary")
    sums = sent.groupBy("_p", "_s").applyInArrow(summed, "_p int, _s int, fps binary, blocks binary, times binary")
    with freeing(spark) if screen else nullcontext():
        masks = cut(sums.groupBy("_p").applyInArrow(repeated, "_b int, _p int, data binary"), "masks")
        if screen:
            kinds_told = docs.groupBy("_b").cogroup(masks.groupBy("_b")).applyInArrow(tell, "_p int, _b int, tags binary, wholes binary, ids binary, docs binary, starts binary")
            masks = masks.unionByName(cut(kinds_told.groupBy("_p").applyInArrow(judge, "_b int, _p int, data binary"), "verdicts"))
    asked = docs.groupBy("_b").cogroup(masks.groupBy("_b")).applyInArrow(request, "_p int, _b int, keys binary, sizes binary, units binary, more binary")
    answers = asked.groupBy("_p").applyInArrow(reply, "_b int, _p int, data binary")
    return docs.groupBy("_b").cogroup(masks.unionByName(answers).groupBy("_b")).applyInArrow(finish, schema)


def flagged(c: Contexts | None, replies, all_ones: Callable) -> np.ndarray:
    """The unit positions at which a repeated window starts, from replies that are a bit for each window. ``all_ones(occurrences, first, kind_of, count)``:
    contexts whose windows are all repeated, whatever was answered."""
    if c is None or not len(c.first):
        return np.zeros(0, np.int64)
    answers, first, kind_of, count = replies
    windows = c.last[first] - c.first[first] + 1
    begin = np.cumsum(windows) - windows
    found = np.zeros(int(windows.sum()), bool)
    for i, data in answers:
        mine = np.unpackbits(np.frombuffer(data, np.uint8), count=int(windows[i].sum())).astype(bool)
        found[np.repeat(begin[i] - (np.cumsum(windows[i]) - windows[i]), windows[i]) + np.arange(len(mine))] = mine
    every = all_ones(np.arange(len(c.first)), first, kind_of, count)
    n = c.last - c.first + 1
    ctx = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(ctx)) - np.repeat(np.cumsum(n) - n, n)
    hit = found[begin[kind_of[ctx]] + k] | every[ctx]
    return np.unique((c.first[ctx] + k)[hit])


def covered(starts: np.ndarray, K: int, n: int) -> np.ndarray:
    """Which of n units lie in a window of K that begins at one of ``starts``."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + K, -1)
    return np.cumsum(step[:-1]) > 0
