"""The registered queries: against SQL where there is any, the others against brute force on the small tables."""

import hashlib
import os
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import DATA, connect, same
from fixture import crc, jaccard, keyed, mixed, on_disk, reference_tokens, substrings, windows

import corpus_pipeline
from sylvaframe.llm import packing, registry

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("key", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, key):
    same(registry.queries()[key](spark, FOLDER), connect(FOLDER), registry.oracle_sql()[key])


def test_language_id_accuracy(spark):
    folder = f"{DATA}/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = [r for r in registry.queries()["op1_language_id"](spark, folder).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_against_brute_force(spark, docs):
    run = lambda key: [tuple(r) for r in registry.queries()[key](spark, FOLDER).collect()]
    assert keyed(run("op2_suffix_dedup")) == keyed(substrings(docs))
    assert keyed(run("op8_substring_dedup")) == keyed(windows(docs))
    assert sorted(run("op5_ngram_jaccard")) == jaccard(docs)
    tokens = sorted(reference_tokens(docs))
    starts = [0, *np.cumsum([len(x) for _, x in tokens]).tolist()]
    assert sorted(run("op3_token_output")) == [(d, at, len(x), crc(x)) for (d, x), at in zip(tokens, starts)]
    check_pieces(run("op13_sentencepiece"), docs)
    check_packing(run("op6_best_fit_packing"), docs)
    check_media(run("op7_media_columns"), docs)


def check_pieces(got, docs):
    import sentencepiece

    from sylvaframe.llm import pieces

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = [(d, sp.encode(t or "")) for d, t in docs]
    assert sorted(got) == sorted((d, len(x), digest(",".join(map(str, x))), digest(sp.decode(x))) for d, x in ids)


def check_packing(got, docs):
    """Pieces are as asked, sequences full from 0 without gaps, and as few as the bound says that any packing needs."""
    want, sequences = [], {}
    for d, ids in reference_tokens(docs):
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(d, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(tuple(r[:5]) for r in got) == sorted(want)
    for r in got:
        sequences.setdefault(r[5], []).append((r[6], r[3]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    counts = np.bincount([w[3] for w in want], minlength=1025)
    assert packing.lower_bound(counts) <= len(sequences) <= sum(n for _, n in packing.best_fit(counts))
    return len(sequences), packing.lower_bound(counts)


def check_media(got, docs):
    """Digests of the payload and of the stored file as the standard library writes it, and features by plain loops."""
    import io
    import math
    import wave

    texts = dict(docs)
    assert len(got) == len(docs)
    for doc_id, n, payload_bytes, payload_sha, tail, media_bytes, media_sha, feature in got:
        payload = (texts[doc_id] or "").encode()
        assert n == len(payload)
        payload += bytes(max(64, -(-n // 64) * 64) - n)
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(8000)
            w.writeframes(payload)
        stored = out.getvalue()
        assert (payload_bytes, payload_sha, tail) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (media_bytes, media_sha) == (len(stored), hashlib.sha256(stored).hexdigest())
        x = [b - 128 for b in payload]
        flips = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:])) / (len(x) - 1)
        bins = ",".join(str(sum(64 * k <= b < 64 * k + 64 for b in payload)) for k in range(4))
        assert feature == f"n={len(x)};mean={sum(x) / len(x):.6f};rms={math.sqrt(sum(v * v for v in x) / len(x)):.6f};zcr={flips:.6f};hist={bins}"


def test_packing_meets_the_bound_where_best_fit_does_not(spark):
    folder = f"{DATA}/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    used, bound = check_packing([tuple(r) for r in registry.queries()["op6_best_fit_packing"](spark, folder).collect()], docs)
    counts = np.bincount([n for _, ids in reference_tokens(docs) for n in [1024] * (len(ids) // 1024) + [len(ids) % 1024] if n], minlength=1025)
    assert used == bound < sum(n for _, n in packing.best_fit(counts))


def test_mixing_near_targets(spark):
    for sf, near in (("sf0.001", 0.05), ("sf0.01", 0.03)):
        source = {r.doc_id: r.source for r in spark.read.parquet(f"{DATA}/{sf}/documents.parquet").select("doc_id", "source").collect()}
        taken, target = {}, {}
        for r in registry.queries()["op10_source_mixing"](spark, f"{DATA}/{sf}").collect():
            s = source[r.doc_id]
            taken[s], target[s] = taken.get(s, 0) + r.taken, r.target
            assert r.taken <= 3 * r["size"]
        assert all(abs(taken[s] - target[s]) <= near * target[s] for s in taken)


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "exact dedup", "n-gram Jaccard join", "mixing sources", "best-fit packing"]
    data = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r for r in data.collect()}
    stages = []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        data = f(spark, data, FOLDER)
        data = spark.createDataFrame(data.collect(), data.schema)
        stages.append([r.doc_id for r in data.collect()])
        if k < 4:
            assert data.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    told, exact, near, taken, packed = stages
    assert len(told) >= 0.95 * len(rows)
    last = {}
    for d in told:
        last[rows[d].text] = max(d, last.get(rows[d].text, -1))
    assert sorted(exact) == sorted(last.values())
    assert sorted(near) == sorted(d for d, _, c in jaccard([(d, rows[d].text) for d in exact]) if d == c)
    stay = [(d, rows[d].source, rows[d].text) for d in near]
    assert sorted(taken) == sorted(d for (d, _, _), n in zip(stay, mixed(stay)[0]) for _ in range(n))
    check_packing([tuple(r) for r in data.collect()], [(d, rows[d].text) for d in taken])
    assert sorted(packed) == sorted(r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect())


@pytest.mark.parametrize("rows", [[], [(None, None)] * 3, [(k, None) for k in range(4)]])
def test_pipeline_of_empty_tables(spark, tmp_path, rows):
    on_disk(spark, tmp_path, rows).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
