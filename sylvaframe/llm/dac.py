"""Token-ID output as directly addressable codes.

An id is cut into chunks of 8 bits, lowest first. Level 0 holds the first chunk of every id, and a bitmap tells which
ids continue; level 1 holds the second chunk of those that do, and so on. A directory holds, for each 512 bits of a
bitmap, how many bits are set before it. The place of an id's next chunk is the rank of its bit, so any token is
read by itself: no block is decoded.

A file holds a run of documents in ascending id order:

    magic, header length, JSON header | ids of the documents, their first tokens | per level: chunks, bitmap, directory

Spark sorts the documents by range, each task writes the files of its range (a new one after ``SEGMENT`` tokens) into the shared
folder, and a manifest of (part, file, tokens) gives each file's first token by a running sum. A file that a lost or
repeated task left behind is in no manifest and is never read.

Defined cases: a null or empty text has the end id only; null ids come first; rows that share an id lie side by
side, ordered by text; an empty table gives no file and no row; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .env import cut, scratch, ready

MAGIC = b"DAC1"
SEGMENT = 8 << 20
BLOCK = 512


def pack(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The levels of ``ids``: (chunks, bitmap as 64-bit words, directory)."""
    levels, rest = [], ids.astype(np.uint32, copy=False)
    while True:
        more = rest > 0xFF
        bits = np.zeros(-(-max(len(rest), 1) // BLOCK) * BLOCK // 8, np.uint8)
        packed = np.packbits(more, bitorder="little")
        bits[: len(packed)] = packed
        words = bits.view("<u8")
        set_in_block = np.bitwise_count(words).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
        directory = np.zeros(len(set_in_block), "<u4")
        np.cumsum(set_in_block[:-1], out=directory[1:])
        levels.append(((rest & 0xFF).astype(np.uint8), words, directory))
        rest = rest[more] >> 8
        if not len(rest):
            return levels


class Codes:
    """Random access to the ids of one file's bytes."""

    def __init__(self, data: bytes | memoryview):
        data = memoryview(data)
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        size = int.from_bytes(data[4:8], "little")
        self.header = json.loads(bytes(data[8 : 8 + size]))
        at = 8 + size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        docs = self.header["docs"]
        self.doc_ids, self.doc_null, self.starts = take("<i8", docs), take("u1", docs), take("<u8", docs + 1)
        self.levels = [(take("u1", n), take("<u8", w), take("<u4", d)) for n, w, d in self.header["levels"]]

    def __len__(self) -> int:
        return int(self.starts[-1])

    def at(self, index: np.ndarray) -> np.ndarray:
        """The ids at the given places, each found by ranks alone."""
        index = np.asarray(index, np.int64)
        out = np.zeros(len(index), np.uint32)
        live, place = np.arange(len(index)), index
        for k, (chunks, words, directory) in enumerate(self.levels):
            out[live] |= chunks[place].astype(np.uint32) << np.uint32(8 * k)
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            goes_on = (words[word] >> bit) & np.uint64(1) == 1
            live, place, word, bit = live[goes_on], place[goes_on], word[goes_on], bit[goes_on]
            if not len(live):
                break
            block = place >> 9
            rank = directory[block].astype(np.int64) + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            for j in range(BLOCK // 64 - 1):  # the whole words of the block before this one
                before = (block << 3) + j
                rank += np.where(before < word, np.bitwise_count(words[before]), 0)
            place = rank
        return out

    def rank(self, level: int, place: int) -> int:
        """How many ids of a level before ``place`` continue."""
        _, words, directory = self.levels[level]
        block, word = place >> 9, place >> 6
        if block == len(directory):
            block -= 1
        inner = np.bitwise_count(words[block << 3 : word]).sum()
        if place & 63:
            inner += np.bitwise_count(words[word] & ((np.uint64(1) << np.uint64(place & 63)) - np.uint64(1)))
        return int(directory[block]) + int(inner)

    def between(self, a: int, b: int) -> np.ndarray:
        """The ids at places a..b-1: what continues of them lies side by side on the next level, from the rank of a."""
        out = np.zeros(b - a, np.uint32)
        live = np.arange(b - a)
        for k, (chunks, words, _) in enumerate(self.levels):
            out[live] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * k)
            bits = np.unpackbits(words[a >> 6 : -(-b // 64)].view(np.uint8), bitorder="little")[a & 63 : (a & 63) + b - a]
            live = live[bits == 1]
            if not len(live):
                break
            a = self.rank(k, a)
            b = a + len(live)
        return out

    def doc(self, k: int) -> np.ndarray:
        return self.between(int(self.starts[k]), int(self.starts[k + 1]))


def to_bytes(doc_ids: list[int | None], texts_ids: list[bytes]) -> bytes:
    ids = np.frombuffer(b"".join(texts_ids), "<u4")
    starts = np.zeros(len(texts_ids) + 1, "<u8")
    np.cumsum([len(x) // 4 for x in texts_ids], out=starts[1:])
    levels = pack(ids)
    header = json.dumps({"docs": len(doc_ids), "levels": [[len(c), len(w), len(d)] for c, w, d in levels]}).encode()
    parts = [MAGIC, len(header).to_bytes(4, "little"), header, np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is None for x in doc_ids], "u1"), starts]
    return b"".join(x if isinstance(x, bytes) else x.tobytes() for x in [*parts, *(a for level in levels for a in level)])


def write(docs: DataFrame, folder: str, path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Writes the files below ``folder``; the manifest: (part, seq, file, first, tokens, docs)."""
    ready(docs.sparkSession)
    path = path or tokens.default_path()

    def task(batches: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        encode, part, rows, seq = tokens.encoder(path).encode, TaskContext.get().partitionId(), [], 0
        ids, held, size = [], [], 0

        def flush() -> None:
            nonlocal ids, held, size, seq
            name = f"part-{part:07d}-{seq:05d}-{uuid.uuid4().hex}.dac"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(to_bytes(ids, held))
            rows.append((part, seq, f"{folder}/{name}", size, len(ids)))
            ids, held, size, seq = [], [], 0, seq + 1

        for batch in batches:
            for one, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = encode(body.as_py())
                ids.append(one)
                held.append(got)
                size += len(got) // 4
                if size >= SEGMENT:
                    flush()
        if ids:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["part", "seq", "file", "tokens", "docs"])

    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = ordered.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    made = cut(ordered.mapInArrow(task, "part long, seq long, file string, tokens long, docs long"))
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)  # a row for each file
    return made.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for file, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist()):
                store, name = fs.FileSystem.from_uri(file)
                with store.open_input_file(name) as f:
                    codes = Codes(f.read())
                lengths = np.diff(codes.starts.astype(np.int64))
                crcs = np.zeros(len(lengths), np.int64)
                k = 0
                while k < len(lengths):  # about a million ids at a time
                    to = max(k + 1, int(np.searchsorted(codes.starts, codes.starts[k] + np.uint64(1 << 20), "right")) - 1)
                    base = int(codes.starts[k])
                    raw = memoryview(codes.between(base, int(codes.starts[to])).astype("<u4")).cast("B")
                    for j in range(k, to):
                        crcs[j] = zlib.crc32(raw[(int(codes.starts[j]) - base) * 4 : (int(codes.starts[j + 1]) - base) * 4])
                    k = to
                yield pa.RecordBatch.from_arrays([pa.array(codes.doc_ids, mask=codes.doc_null.astype(bool)), pa.array(codes.starts[:-1].astype(np.int64) + first), pa.array(lengths), pa.array(crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = manifest.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "first").repartition(parts, "file").mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    return read(write(docs, scratch(docs.sparkSession, "dac"), path))
