"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of whole sample texts; a text is encoded with every dictionary, and
the language whose encoding is smallest wins. Texts are lower-cased first and encoded in pieces of ``PIECE`` bytes, all of
them, so that a long text cannot learn its own words and make the dictionaries look alike.

The score is the margin, 1 - smallest / second smallest. A text is rejected when it has no letter or when the margin is
below ``margin``: it is too short or too odd to tell. The prediction itself is given in any case where there is
a letter, since a caller may have another use for it.

The fit reads a bounded sample: of each language the first ``TEXT_CHARS`` characters of different texts, in the order of a hash of the text, while they come to
less than ``DICTIONARY_BYTES``; so much and one text more is what reaches the driver for a language, and no language is without a text. More than
``SHARED_BY`` languages share what so many would have, so that the dictionaries together stay within ``SHARED_BY * DICTIONARY_BYTES`` and a text for each. Which
rows are looked at is estimated from how many different texts there are; where that was too few, more are looked at, so the sample doesn't depend on the
estimate, nor on how often a text repeats. A language is only learned from rows that have a label and, for the registered query, are not held out.

Defined cases: null text, or text without a letter: ``und``, score 0, rejected; equal sizes: the more frequent
language, score 0; no labelled row at all: every text is ``und``; rows that share an id are predicted each; an empty
table gives an empty result; extra columns are kept by ``keep_identified`` and ignored by ``identify``.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import FEW
from .env import packed, ready

LEVEL, PIECE = 6, 4096
#: Equal sizes are told apart by the strongest encoding, which also finds matches of three bytes.
FINE_LEVEL = 19
SHARED_BY, DICTIONARY_BYTES, TEXT_CHARS = 100, 250_000, 10_000
#: Bits of the hash by which texts are drawn; how many times the bytes that are needed are looked at.
DRAW_BITS, AMPLE = 40, 3
#: Margins below this are too narrow.
MARGIN = 0.002
LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> list[tuple[str, bytes]]:
    """[(language, dictionary)], the most frequent language first, from a bounded sample of the labelled rows."""
    labelled = rows.select(F.col(text).alias("t"), F.col(lang).alias("l")).filter("l IS NOT NULL AND t <> ''")

    def cut_at(chars: int) -> DataFrame:
        ok = labelled.select("l", F.substring("t", 1, chars).alias("t"))
        return ok.select("l", "t", F.octet_length("t").alias("n"), F.pmod(F.xxhash64("t", F.lit("langid")), F.lit(1 << DRAW_BITS)).alias("d"))

    # different texts by how small their draw is: half of them are at 0, a quarter at 1, and so on
    level = F.when(F.col("d") > 0, F.lit(DRAW_BITS - 1) - F.floor(F.log2("d"))).otherwise(DRAW_BITS).alias("level")
    seen: dict[str, list] = {}
    for r in cut_at(TEXT_CHARS).groupBy("l", level).agg(F.approx_count_distinct("d").alias("texts"), F.avg("n").alias("mean"), F.sum("n").alias("bytes")).collect():
        seen.setdefault(r.l, []).append(r)
    order = sorted(seen, key=lambda x: (-sum(r.bytes for r in seen[x]), x))
    budget = DICTIONARY_BYTES * SHARED_BY // max(SHARED_BY, len(order))
    ok = cut_at(max(1, min(TEXT_CHARS, budget)))
    depth = {}  # of each language, the level from which its texts are looked at
    for one in order:
        depth[one], found = 0, 0.0
        for r in sorted(seen[one], key=lambda r: -r.level):
            found += r.texts * r.mean
            if found >= AMPLE * budget:
                depth[one] = r.level
                break
    texts: dict[str, list] = {}
    while depth:
        reach = rows.sparkSession.createDataFrame([(x, 1 << (DRAW_BITS - k)) for x, k in depth.items()], "l STRING, most LONG")
        reach = F.broadcast(reach) if len(depth) <= FEW else reach  # else all texts would be shuffled, by a few languages
        sample = ok.join(reach, "l").filter("d < most").dropDuplicates(["l", "d", "t"])
        before = F.coalesce(F.sum("n").over(W.partitionBy("l").orderBy("d", "t").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        for x in depth:
            texts[x] = []
        for r in sample.withColumn("before", before).filter(F.col("before") < budget).select("l", "d", "t", "n").collect():
            texts[r.l].append((r.d, r.t, r.n))
        depth = {x: max(0, k - 4) for x, k in depth.items() if k and sum(n for *_, n in texts[x]) < budget}
    return [(x, b"\n".join(t.lower().encode() for _, t, _ in sorted(texts[x], reverse=True))) for x in order]


@lru_cache(2)
def _encoders(model: tuple[tuple[str, bytes], ...], level: int) -> list:
    import zstandard

    out = []
    for lang, content in model:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append((lang, zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def sizes(model: tuple[tuple[str, bytes], ...], text: str, level: int = LEVEL) -> list[tuple[int, str]]:
    """(encoded bytes, language), in the model's order."""
    data = text.lower().encode()
    parts = [data[k : k + PIECE] for k in range(0, len(data), PIECE)]
    return [(sum(len(c.compress(p)) for p in parts), lang) for lang, c in _encoders(model, level)]


def predict(model: tuple[tuple[str, bytes], ...], text: str | None) -> tuple[str, float]:
    if not text or not model or not LETTER.search(text):
        return "und", 0.0
    found = sorted(sizes(model, text), key=lambda x: x[0])  # stable: ties keep the model's order
    if len(found) > 1 and found[0][0] == found[1][0]:
        found = sorted(sizes(model, text, FINE_LEVEL), key=lambda x: x[0])
    return found[0][1], 1.0 - found[0][0] / found[1][0] if len(found) > 1 else 1.0


def predictor(model: list[tuple[str, bytes]]):
    """A function of a column of texts: struct(lang, score)."""
    frozen = tuple(model)

    @F.pandas_udf("lang string, score double")
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([predict(frozen, t) for t in texts], columns=["lang", "score"])

    return found


def identify(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row; learns from the rows that are not held out."""
    ready(docs.sparkSession, 500)
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    found = predictor(model)(F.col("text"))
    rows = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), found.alias("_f"))
    return rows.select("doc_id", "held_out", F.col("_f.lang").alias("lang_pred"), F.col("_f.score").alias("score"), ((F.col("_f.lang") == "und") | (F.col("_f.score") < margin)).alias("rejected"))


def keep_identified(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is told and not narrowly."""
    ready(docs.sparkSession, 500)
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    rows = packed(docs).withColumn("found", predictor(model)(F.col("row.text")))
    return rows.filter((F.col("found.lang") != "und") & (F.col("found.score") >= margin)).select("row.*")
