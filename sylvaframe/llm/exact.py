"""Exact deduplication by two passes over a Bloom filter, with DataFrame functions only.

Pass 1 counts, for every row, two slots of a Bloom filter of ``2**log2_bits`` bits, ``BITS_A_ROW`` for each row. A slot that at least two rows
hit is "repeated"; one that at least ``hot_rows`` rows hit is also "hot". Both are kept as 64-bit words.
Pass 2 looks the two slots of each row up. A row with a slot of its own has a text of its own and passes straight
through; only the other rows, as (id, digest), are shuffled and grouped.

The words are broadcast. The filter has at most ``2**MOST_LOG2_BITS`` bits, so the broadcast has a fixed bound (2**22 rows of
24 bytes). An input of more than some 50 million rows fills it: more rows are shuffled, and the result stays the same.

Groups that are hot in the filter are salted: their rows are dealt over ``salts`` keys, and the group's single
result row is repeated for each of them.

Nothing depends on how a scan cuts or orders the input, which changes when executors come or go: rows are joined by their
digests. Where rows that share text and id have to be told apart (``exact_duplicates``) they are numbered once, in a
table of ids and digests (``env.cut``); a text's node is numbered once, with the text.

Defined cases: a null text counts as empty; a null id is the smallest id; of rows that share text *and* id
exactly one stays; an empty table gives an empty result; extra columns are carried by ``drop_exact_duplicates``
and ignored by ``exact_duplicates``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .env import cut, packed

BITS_A_ROW, LEAST_LOG2_BITS, MOST_LOG2_BITS, HOT_ROWS, SALTS = 16, 16, 28, 64, 64


def filter_bits(rows: int) -> int:
    """The power of two of the filter's size for so many rows."""
    return min(max((BITS_A_ROW * rows).bit_length(), LEAST_LOG2_BITS), MOST_LOG2_BITS)


def _slots(h: Column, log2_bits: int) -> tuple[Column, Column]:
    mask = F.lit((1 << log2_bits) - 1)
    return h.bitwiseAND(mask), F.shiftrightunsigned(h, 64 - log2_bits)


def repeated_slots(docs: DataFrame, h: Column, log2_bits: int | None = None, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, int]:
    """Pass 1: (word, repeated, hot), the 64-bit words of the filter that have a repeated slot, written once, and the filter's size as a power
    of two. ``h``: the texts' 64-bit hash."""
    log2_bits = log2_bits or filter_bits(docs.count())
    slot = F.explode(F.array(*_slots(h, log2_bits))).alias("slot")
    counts = docs.select(slot).groupBy("slot").count()
    bit = F.expr("shiftleft(1L, cast(slot & 63 AS INT))")
    words = (
        counts.filter("count >= 2")
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(bit).alias("repeated"), F.bit_or(F.when(F.col("count") >= hot_rows, bit).otherwise(F.lit(0).cast("long"))).alias("hot"))
    )
    return cut(words, "filter"), log2_bits


def flag_repeated(docs: DataFrame, h: Column, filter_of: tuple[DataFrame, int]) -> DataFrame:
    """Pass 2: ``docs`` with ``_maybe`` (the text may occur again) and ``_hot`` (it may occur very often)."""
    words, log2_bits = F.broadcast(filter_of[0]), filter_of[1]
    out = docs
    for k, slot in enumerate(_slots(h, log2_bits)):
        own = words.select(F.col("word").alias(f"_w{k}"), F.col("repeated").alias(f"_r{k}"), F.col("hot").alias(f"_h{k}"))
        out = out.withColumn(f"_s{k}", slot).join(own, F.shiftright(F.col(f"_s{k}"), 6) == F.col(f"_w{k}"), "left")
    hit = lambda kind: F.expr(" AND ".join(f"coalesce(shiftright(_{kind}{k}, cast(_s{k} & 63 AS INT)) & 1L, 0L) = 1L" for k in (0, 1)))
    return out.withColumn("_maybe", hit("r")).withColumn("_hot", hit("h")).drop(*(f"_{c}{k}" for c in "wrhs" for k in (0, 1)))


def _salted(groups: DataFrame, salts: int) -> DataFrame:
    """``groups`` once for each salt that its rows use."""
    return groups.withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")


def _salt(salts: int) -> Column:
    """Deals hot rows over the salts; which row gets which makes no difference."""
    return F.when(F.col("_hot"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")).otherwise(F.lit(0))


def _body(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", log2_bits: int | None = None, hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: (doc_id, keep_id, group_size, kept, text_sha256)."""
    body = _body(text)
    rows = docs.select(F.col(doc_id).alias("_id"), F.unhex(F.sha2(body, 256)).alias("_sha"), F.xxhash64(body).alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    rows = cut(rows, "digests")
    rows = flag_repeated(rows, F.col("_hash"), repeated_slots(rows, F.col("_hash"), log2_bits, hot_rows))
    digest = F.lower(F.hex("_sha")).alias("text_sha256")
    once = rows.filter(~F.col("_maybe")).select(F.col("_id").alias("doc_id"), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), digest)
    many = rows.filter("_maybe").select("_id", "_row", "_sha", "_hot")
    groups = many.groupBy("_sha", "_hot").agg(F.max(F.struct("_id", "_row")).alias("_stays"), F.count(F.lit(1)).alias("_size"))
    found = many.withColumn("_salt", _salt(salts)).drop("_hot").join(_salted(groups, salts), ["_sha", "_salt"])
    return once.unionByName(found.select(F.col("_id").alias("doc_id"), F.col("_stays._id").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("_row") == F.col("_stays._row")).alias("kept"), digest))


def drop_exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", log2_bits: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names: of equal texts, the row with the largest id.
    Rows whose text is surely unique are not shuffled."""
    body = F.coalesce(F.col("row")[text], F.lit(""))
    rows = packed(docs)
    rows = flag_repeated(rows, F.xxhash64(body), repeated_slots(rows, F.xxhash64(body), log2_bits, hot_rows))
    stays = F.max_by("row", F.struct(F.col("row")[doc_id])).alias("row")  # a struct is not null where the id is
    many = rows.filter("_maybe").groupBy(F.unhex(F.sha2(body, 256)).alias("_sha")).agg(stays)
    return rows.filter(~F.col("_maybe")).select("row.*").unionByName(many.select("row.*"))


def text_filter(docs: DataFrame) -> tuple[DataFrame, int]:
    """What ``distinct_texts`` and ``members`` need, for both of them."""
    return repeated_slots(docs, F.xxhash64(_body("text")))


def distinct_texts(docs: DataFrame, filter_of: tuple[DataFrame, int]) -> DataFrame:
    """(node, text, doc_id, _sha, _hot) for every different text of ``docs``: doc_id, text. The digest is null where the text
    has one row only, whose id is ``doc_id``. To be written before it is used, as the nodes are numbered anew each time."""
    rows = flag_repeated(docs.select("doc_id", "text"), F.xxhash64(_body("text")), filter_of)
    once = rows.filter(~F.col("_maybe")).select("text", "doc_id", F.lit(None).cast("binary").alias("_sha"), F.lit(False).alias("_hot"))
    many = rows.filter("_maybe").groupBy(F.unhex(F.sha2(_body("text"), 256)).alias("_sha"), "_hot").agg(F.first(_body("text")).alias("text"))
    many = many.select("text", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "_sha", "_hot")
    return once.unionByName(many).select(F.monotonically_increasing_id().alias("node"), "text", "doc_id", "_sha", "_hot")


def members(docs: DataFrame, texts: DataFrame, filter_of: tuple[DataFrame, int]) -> DataFrame:
    """(doc_id, node) for every row of ``docs``: the node is the same for equal texts. ``texts``: ``distinct_texts(docs)`` as written."""
    rows = flag_repeated(docs.select("doc_id", "text"), F.xxhash64(_body("text")), filter_of)
    many = rows.filter("_maybe").select("doc_id", F.unhex(F.sha2(_body("text"), 256)).alias("_sha"), _salt(SALTS).alias("_salt"))
    named = _salted(texts.filter("_sha IS NOT NULL").select("node", "_sha", "_hot"), SALTS)
    return texts.filter("_sha IS NULL").select("doc_id", "node").unionByName(many.join(named, ["_sha", "_salt"]).select("doc_id", "node"))


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
