"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dac, exact, factors, jaccard, langid, media, merkle, mixing, packing, pieces, search, suffixes, urls
from .env import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda s, d: table(s, d, "documents")
    return {
        "op1_language_id": lambda s, d: langid.identify(docs(s, d)),
        "op2_suffix_dedup": lambda s, d: suffixes.deduplicate(docs(s, d)),
        "op3_token_output": lambda s, d: dac.round_trip(docs(s, d)),
        "op4_url_filter": lambda s, d: urls.judge(table(s, d, "pages"), urls.rule_table(s)),
        "op5_ngram_jaccard": lambda s, d: jaccard.components_of(docs(s, d)),
        "op6_best_fit_packing": lambda s, d: packing.pack(docs(s, d)),
        "op7_media_columns": lambda s, d: media.round_trip(docs(s, d)),
        "op8_substring_dedup": lambda s, d: factors.deduplicate(docs(s, d)),
        "op9_exact_dedup": lambda s, d: exact.exact_duplicates(docs(s, d)),
        "op10_source_mixing": lambda s, d: mixing.mixed(docs(s, d)),
        "op11_ranked_search": lambda s, d: search.search(docs(s, d), table(s, d, "benchmark")),
        "op12_merkle_manifest": lambda s, d: merkle.audited(docs(s, d)),
        "op13_sentencepiece": lambda s, d: pieces.round_trip(docs(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": urls.SQL, "op9_exact_dedup": exact.SQL, "op10_source_mixing": mixing.SQL, "op11_ranked_search": search.SQL, "op12_merkle_manifest": merkle.SQL}
