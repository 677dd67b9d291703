"""Ranked lexical search: the best documents of each query, term at a time with a limited set of accumulators.

The documents become an inverted file: each task writes, for every ``BLOCK`` documents it has read, their ids and lengths and, for each term that a query may
hold, a row of the block's documents and occurrences. Terms of no query are left out by a bitmap of fixed size over the terms' hashes; one that
slips through is dropped by the join with the queries' terms. Number of documents, terms and document frequencies come from the inverted file, by aggregation.

Queries are dealt into chunks of ``CHUNK``; a group is a block and a chunk, so it is bounded whatever the tables' sizes, and holds the block's rows for the chunk's terms.
In it a query's terms come rarest first, and every document that has one gets an accumulator (``Search.best``). Once what the remaining terms can add at most
is less than the k-th largest partial score, a document without an accumulator can't come among the k best, so none are created any more; the
remaining terms only raise those that exist, exactly. Each group gives its k best of each query, and the k best of these are the answer.

Defined cases: a null or empty text has no term and is never found; a query without a term, or whose terms are in no document, has no rows; equal scores go by id,
null first; rows that share an id are documents of their own; rows of ``items`` that share an id are queries of their own, ranked each from 1; empty tables give an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import lookup
from .env import cut, ready

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of terms as they are or lower-cased, all others as spaces.
BYTES = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Documents of a block, queries of a chunk, bits of the terms' bitmap as a power of two, terms that a worker remembers.
BLOCK, CHUNK, MASK_BITS, REMEMBERED = 4096, 1024, 22, 300_000
INDEX = "block long, term binary, docs binary, counts binary, ids binary, nulls binary, documents long, terms long"


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(BYTES).split()


def slot(term: bytes) -> int:
    return zlib.crc32(term) & ((1 << MASK_BITS) - 1)


def query_terms(items: DataFrame, text: str, item_id: str) -> DataFrame:
    """(item, item_id, term, times), written once: an item is a row of ``items``."""
    rows = cut(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(text).alias("text")), "items")
    found = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0)))
    return cut(rows.select("item", "item_id", found.alias("term")).withColumn("term", F.encode("term", "UTF-8")).groupBy("item", "item_id", "term").agg(F.count("*").alias("times")), "items")


def mask_of(terms: DataFrame) -> bytes:
    """A bit for each slot that a term has: 2**MASK_BITS bits, so what comes to the driver is bounded."""
    at = F.crc32("term").bitwiseAND(F.lit((1 << MASK_BITS) - 1))
    words = terms.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(crc32(term) & 63L AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << MASK_BITS - 6, np.int64)
    for r in words.collect():
        out[r.word] = r.bits
    return out.tobytes()


def index(docs: DataFrame, terms: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The inverted file of ``docs`` for the given terms, written once. A row without a term is a block's: its documents' ids and numbers of terms."""
    import pyarrow as pa

    ready(docs.sparkSession)
    packed = mask_of(terms)

    def rows(block: int, held: list) -> pa.RecordBatch:
        docs, counts, lengths, ids = {}, {}, [], []
        for k, (i, length, found) in enumerate(held):
            ids.append(i)
            lengths.append(length)
            for term, n in found:
                docs.setdefault(term, []).append(k)
                counts.setdefault(term, []).append(n)
        names = [None, *docs]
        number = lambda x, kind: np.array(x, kind).tobytes()
        columns = (
            [block] * len(names), names, [None, *(number(docs[t], "<u2") for t in docs)], [number(lengths, "<i4"), *(number(counts[t], "<i4") for t in docs)],
            [number([i or 0 for i in ids], "<i8")] + [None] * len(docs), [number([i is None for i in ids], "u1")] + [None] * len(docs),
            [sum(n > 0 for n in lengths)] + [len(docs[t]) for t in docs], [sum(lengths)] + [0] * len(docs),
        )
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [c.split()[0] for c in INDEX.split(", ")])

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        mask = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")
        block, held, asked = TaskContext.get().partitionId() << 32, [], {}
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = terms_of(t or "")
                counts = Counter(words)
                if len(asked) > REMEMBERED:
                    asked.clear()
                for term in counts:
                    if term not in asked:
                        asked[term] = mask[slot(term)]
                held.append((i, len(words), [(term, n) for term, n in counts.items() if asked[term]]))
                if len(held) == BLOCK:
                    yield rows(block, held)
                    block, held = block + 1, []
        if held:
            yield rows(block, held)

    return cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, INDEX), "index")


class Search:
    """The documents of a block and, of each term, (its weight, documents, occurrences)."""

    def __init__(self, ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, documents: int, terms: int):
        self.ids, self.nulls = ids, nulls
        self.m = 100 - 75 + (75 * lengths.astype(np.int64) * documents) // max(terms, 1)
        self.gains: dict[bytes, tuple[int, np.ndarray, np.ndarray, int]] = {}

    def add(self, term: bytes, df: int, weight: int, docs: np.ndarray, counts: np.ndarray) -> None:
        tf = counts.astype(np.int64)
        gain = weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * self.m[docs]))
        self.gains[term] = df, docs, gain, int(gain.max())

    def best(self, query: list[tuple[bytes, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents and their scores, best first. ``query``: terms and how often each is in it."""
        found = sorted((self.gains[t][0], t, n) for t, n in query if t in self.gains)
        left = sum(self.gains[t][3] * n for _, t, n in found)
        scores, made, creating = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool), True
        for _, term, n in found:
            _, docs, gain, most = self.gains[term]
            if creating and (count := int(made.sum())) >= k:
                partial = scores[made]
                creating = left >= np.partition(partial, count - k)[count - k]
            if not creating:
                on = made[docs]
                docs, gain = docs[on], gain[on]
            scores[docs] += gain * n
            made[docs] = True
            left -= most * n
        at = np.flatnonzero(scores > 0)
        if len(at) > k:
            at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
        at = at[np.lexsort((self.ids[at], ~self.nulls[at].astype(bool), -scores[at]))][:k]
        return at, scores[at]


def search(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    import pyarrow as pa
    import pyarrow.compute as pc

    terms = query_terms(items, item_text, item_id)
    inverted = index(docs, terms, text, doc_id)
    heads, lists = inverted.filter("term IS NULL"), inverted.filter("term IS NOT NULL")
    total = heads.agg(F.sum("documents").alias("n"), F.sum("terms").alias("l")).first()
    documents, length = total.n or 0, total.l or 0
    chunks = 1 + terms.select("item").distinct().count() // CHUNK
    terms = terms.withColumn("chunk", F.pmod(F.xxhash64("item"), F.lit(chunks)))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * documents + 2) / (2.0 * F.col("df") + 1))).cast("long")
    known = lists.groupBy("term").agg(F.sum("documents").alias("df")).withColumn("weight", weight)
    asked = lookup(terms.select("term", "chunk").distinct().join(known, "term"), "asked")
    query = F.collect_list(F.struct("term", "times")).alias("query")
    queries = terms.groupBy("chunk", "item", "item_id").agg(query).groupBy("chunk").agg(F.collect_list(F.struct("item", "item_id", "query")).alias("queries"))
    blocks = heads.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))).join(cut(queries, "queries"), "chunk")
    columns = ["block", "chunk", "term", "docs", "counts", "ids", "nulls", "df", "weight", "queries"]
    groups = lists.join(asked, "term").select(*columns[:-1]).unionByName(blocks.select(*(c for c in columns if c not in ("df", "weight"))), allowMissingColumns=True)

    def run(table):
        head, tail = table.filter(pc.is_null(table.column("term"))).to_pylist()[0], table.filter(pc.is_valid(table.column("term"))).to_pydict()
        block = Search(*(np.frombuffer(head[c], kind) for c, kind in (("ids", "<i8"), ("nulls", "u1"), ("counts", "<i4"))), documents, length)
        for term, df, w, own, counts in zip(*(tail[c] for c in ("term", "df", "weight", "docs", "counts"))):
            block.add(term, df, w, np.frombuffer(own, "<u2"), np.frombuffer(counts, "<i4"))
        out = []
        for q in head["queries"]:
            at, scores = block.best([(t["term"], t["times"]) for t in q["query"]], k)
            out += [(q["item"], q["item_id"], None if block.nulls[j] else int(block.ids[j]), int(x)) for j, x in zip(at, scores)]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, schema.types)], schema=schema)

    id_type = items.schema[item_id].dataType.simpleString()
    schema = pa.schema([("item", pa.int64()), ("item_id", {"bigint": pa.int64(), "int": pa.int32()}.get(id_type, pa.string())), ("doc_id", pa.int64()), ("score", pa.int64())])
    found = groups.groupBy("block", "chunk").applyInArrow(run, f"item long, item_id {id_type}, doc_id long, score long")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "doc_id")).alias("rank")
    return found.select("item_id", rank, "doc_id", "score").filter(F.col("rank") <= k)


_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
stats AS (SELECT count(*) FILTER (len(terms) > 0) AS n, sum(len(terms))::BIGINT AS l FROM d),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, floor(1000 * ln((2 * (SELECT n FROM stats) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf GROUP BY term),
m AS (SELECT row, doc_id, 100 - 75 + (75 * len(terms) * n) // l AS m FROM d, stats WHERE len(terms) > 0),
q AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS item, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item, item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN m USING (row) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
