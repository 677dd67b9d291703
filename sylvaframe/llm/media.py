"""Media columns: a Spark data source over directories of archives.

Format ``media_archive`` (a Python data source). Writing: each task streams its rows into ZIP archives of its own, one
member a row: an 8-bit mono WAV file whose samples are the payload, deflated. A commit names the archives of the tasks that
succeeded in a manifest of its own, so what a lost or repeated task left behind is never read, and a folder can be appended to; a reader takes all
manifests of the folder. An abort deletes what the job's tasks have reported.

Reading: the driver plans ranges of bytes over the archives from their names and sizes alone, several archives to a task where there would
be more than ``MOST_TASKS`` otherwise. A task opens its archives one by one,
reads the archive's directory and takes the members that begin in its range. Members are read one by one by offset;
one that fails (a short read, a wrong checksum) is retried from its offset by itself, and payloads are handed to Spark in
Arrow batches of bounded bytes.

Features of a member: the number of samples, their mean and root mean square around the middle (128), the share of sign changes
and a 4-bin histogram, in one string; equal payloads have equal features.

Defined cases: a null or empty text is 64 zero bytes; null ids are kept as such; rows that share an id are members
each; an empty table gives a manifest without archives and no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .env import scratch, ready

UNIT, RATE = 64, 8000
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, TRIES = 32 << 20, 8 << 20, 4 << 20, 3
MOST_TASKS = 100_000
SCHEMA = "doc_id long, n_bytes long, media binary"
MANIFEST = "_manifest-"


def to_payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def to_wav(payload: bytes) -> bytes:
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def from_wav(media: bytes) -> bytes:
    riff, _, wave, fmt, _, _, channels, _, _, _, bits, data, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (riff, wave, fmt, data, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 8) or len(media) != 44 + n:
        raise ValueError("not an 8-bit mono WAV file")
    return media[44:]


def features(payload: bytes) -> str:
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    flips = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    bins = np.bincount(np.frombuffer(payload, np.uint8) >> 6, minlength=4)
    return f"n={len(x)};mean={x.sum() / len(x):.6f};rms={np.sqrt((x * x).sum() / len(x)):.6f};zcr={flips / max(1, len(x) - 1):.6f};hist=" + ",".join(map(str, bins.tolist()))


@dataclass
class Written(WriterCommitMessage):
    archives: list


@dataclass
class Ranges(InputPartition):
    spans: list  # of (archive, first byte, end)


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> Written:
        import uuid

        from pyspark import TaskContext

        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        done, out, box, name, size = [], None, None, "", 0

        def close() -> None:
            nonlocal out, box, size
            if box is not None:
                box.close()
                done.append([name, out.tell()])
                out.close()
            out, box, size = None, None, 0

        for batch in iterator:
            ids, bodies = batch.column("doc_id").to_pylist(), batch.column("payload")
            for doc_id, n, body in zip(ids, batch.column("n_bytes").to_pylist(), bodies):
                if box is None:
                    name = f"{TaskContext.get().partitionId():07d}-{len(done):05d}-{uuid.uuid4().hex}.zip"
                    out = store.open_output_stream(f"{root}/{name}")
                    box = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                media = to_wav(body.as_py())
                box.writestr(zipfile.ZipInfo(f"{'' if doc_id is None else doc_id}/{n}.wav"), media, zipfile.ZIP_DEFLATED, 1)
                size += len(media)
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        return Written(done)

    def commit(self, messages: list) -> None:
        import uuid

        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([a for m in messages if m is not None for a in m.archives]).encode())

    def abort(self, messages: list) -> None:
        store, root = _store(self.path)
        for name, _ in (a for m in messages if m is not None for a in m.archives):
            store.delete_file(f"{root}/{name}")


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[Ranges]:
        from pyarrow import fs

        store, root = _store(self.path)
        archives = []
        for info in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda i: i.base_name):
            if info.base_name.startswith(MANIFEST):
                with store.open_input_stream(info.path) as f:
                    archives += json.loads(f.read())
        each = max(self.range_bytes, -(-sum(size for _, size in archives) // MOST_TASKS))
        out, held = [], 0
        for name, size in archives:
            for at in range(0, size, each):
                if not out or held + min(each, size - at) > each:
                    out.append(Ranges([]))
                    held = 0
                out[-1].spans.append((name, at, at + each))
                held += min(each, size - at)
        return out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator:
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.binary())
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 3, kinds)], ["doc_id", "n_bytes", "media"])
        store, root = _store(self.path)
        rows, size = [], 0
        for archive, start, end in partition.spans:
            with store.open_input_file(f"{root}/{archive}") as f:
                with zipfile.ZipFile(f) as box:
                    members = sorted((m.header_offset, m.filename, m.compress_size, m.file_size, m.CRC) for m in box.infolist() if start <= m.header_offset < end)
                for offset, name, packed, plain, crc in members:
                    media = self.member(f, offset, packed, plain, crc)
                    doc_id, n = name.removesuffix(".wav").split("/")
                    rows.append((int(doc_id) if doc_id else None, int(n), media))
                    size += len(media)
                    if size >= BATCH_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
        yield batch(rows)

    @staticmethod
    def member(f, offset: int, packed: int, plain: int, crc: int, tries: int = TRIES, wait: float = 0.1) -> bytes:
        """The bytes of the member that begins at ``offset``; retried by itself."""
        for left in range(tries - 1, -1, -1):
            try:
                f.seek(offset)
                head = f.read(30)
                mark, method, n_name, n_extra = struct.unpack("<4s4xH16xHH", head)
                if mark != b"PK\x03\x04":
                    raise OSError("no member begins here")
                f.seek(offset + 30 + n_name + n_extra)
                raw = f.read(packed)
                media = zlib.decompress(raw, -15) if method == zipfile.ZIP_DEFLATED else raw
                if len(media) != plain or zlib.crc32(media) != crc:
                    raise OSError("the member is damaged")
                return media
            except (OSError, struct.error, zlib.error):
                if not left:
                    raise
                time.sleep(wait)
        raise AssertionError


class MediaArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def write(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> None:
    spark = docs.sparkSession
    spark.dataSource.register(MediaArchive)
    ready(spark)
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")
    size = F.octet_length(body)
    pad = F.when(size == 0, UNIT).otherwise(F.pmod(-size, F.lit(UNIT)))
    payload = F.concat(body, F.substring(F.unhex(F.lit("00" * UNIT)), F.lit(1), pad))
    docs.select(F.col(doc_id).cast("long").alias("doc_id"), size.cast("long").alias("n_bytes"), payload.alias("payload")).write.format("media_archive").mode("append").option("path", path).save()


def read(spark, path: str) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("path", path).load()


def describe(media: DataFrame) -> DataFrame:
    """The digests and features of stored members."""

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for doc_id, n, m in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media")):
                stored = m.as_py()
                p = from_wav(stored)
                out.append((doc_id, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), features(p)))
            i, s = pa.int64(), pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 8, (i, i, i, s, i, i, s, s))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(task, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def round_trip(docs: DataFrame) -> DataFrame:
    path = scratch(docs.sparkSession, "media")
    write(docs, path)
    return describe(read(docs.sparkSession, path))
