"""The operators and the pipeline on awkward cases against brute force, and on empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from fixture import awkward, crc, frame, jaccard, keyed, on_disk, order, own_ids, reference_tokens, substrings, windows
from pyspark.sql import functions as F

from sylvaframe.llm import components, dac, exact, factors, jaccard as join, langid, media, merkle, mixing, packing, pieces, search, suffixes, tokens, urls
from sylvaframe.llm.env import scratch


def tuples(df):
    return [tuple(r) for r in df.collect()]


# 1


def labelled():
    words = {"en": ["the", "and", "of", "thing", "that", "with", "house", "river"], "fr": ["le", "et", "du", "chose", "que", "avec", "maison", "rivière"]}
    rng = np.random.default_rng(0)
    return [(i, " ".join(rng.choice(words[lang], 30)), lang) for i in range(200) for lang in [("en", "fr")[i % 2]]]


def test_language_id(spark):
    rows = labelled() + [(1000, None, "en"), (1001, "", None), (1002, "12 !?", "fr"), (1003, "THE HOUSE AND THE RIVER " * 300, None), (None, "le et du", None)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert len(got) == len(rows)
    assert [got[k].lang_pred for k in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "en"] and got[1000].rejected and got[1000].score == 0
    held = [r for r in rows[:200] if got[r[0]].held_out]
    assert {r[0] for r in held} == {r[0] for r in rows[:200] if zlib.crc32(str(r[0]).encode()) % 5 == 0}
    assert sum(got[i].lang_pred == lang for i, _, lang in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.keep_identified(df.withColumn("word", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "lang", "word"] and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if not r.rejected}


def test_language_id_learns_from_training_rows_only(spark):
    df = spark.createDataFrame(labelled(), "doc_id LONG, text STRING, lang STRING")
    turned = df.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert sorted(tuples(langid.identify(df))) == sorted(tuples(langid.identify(turned)))
    nothing = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(nothing).collect()} == {"und"}


def test_language_id_loses_no_language(spark):
    """One text in 10**5 rows, few texts repeated very often, more languages than share the dictionaries' room."""
    often = spark.range(100_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "le chat et la maison").otherwise("du pain et une rose").alias("text"), F.lit("fr").alias("lang"))
    few = spark.createDataFrame([(200_000 + i, f"the house and the river {i}", "en") for i in range(50)] + [(300_001, "das Haus und der Fluss", "de")], often.schema)
    model = langid.fit(often.unionByName(few))
    assert [x for x, _ in model] == ["fr", "en", "de"] and sorted(model[0][1].split(b"\n")) == [b"du pain et une rose", b"le chat et la maison"]
    assert model[1][1].count(b"\n") == 49
    many = spark.createDataFrame([(i, " ".join(f"{chr(97 + i % 26)}{i % 150}w{i * 7 + j}" for j in range(30)), f"l{i % 150}") for i in range(1500)], often.schema)
    model = langid.fit(many)
    assert {x for x, _ in model} == {f"l{i}" for i in range(150)} and all(model)
    assert langid.predict(tuple(model), many.filter("doc_id = 149").first().text)[0] == "l149"


def test_language_id_sample_does_not_depend_on_the_estimate(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 500, int(rng.integers(1, 60)))), ("en", "fr")[i % 7 == 0]) for i in range(3000)]
    df = spark.createDataFrame(rows + rows[:500] * 4, "doc_id LONG, text STRING, lang STRING")
    monkeypatch.setattr(langid, "DICTIONARY_BYTES", 5000)
    want = {x: [] for x in ("en", "fr")}
    draws = {r.text: r.d for r in df.select("text", F.pmod(F.xxhash64("text", F.lit("langid")), F.lit(1 << 40)).alias("d")).collect()}
    for x in want:
        total = 0
        for d, t in sorted({(draws[t], t) for _, t, y in rows if y == x}):
            if total < 5000:
                want[x].append(t)
            total += len(t)
    for ample in (3, 0.05):
        monkeypatch.setattr(langid, "AMPLE", ample)
        assert dict(langid.fit(df)) == {x: "\n".join(reversed(t)).encode() for x, t in want.items()}


def test_language_id_equals_a_plain_version(spark):
    """Each prediction again, with one dictionary and one whole compression at a time."""
    import unicodedata

    import zstandard

    odd = [(2000, "½ ² Ⅷ ①", "en"), (2001, "ª", None), (2002, "中文", None), (2003, "a", None), (2004, "the le " * 3000, None)]
    rows = labelled() + odd
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING")
    model = langid.fit(df.filter(~langid.held_out(F.col("doc_id"))))
    assert {lang for lang, _ in model} == {"en", "fr"} and all(len(d) < langid.DICTIONARY_BYTES + 4 * langid.TEXT_CHARS for _, d in model)

    def encoded(dictionary, text, level):
        body, n = text.lower().encode(), 0
        for at in range(0, len(body), langid.PIECE):
            how = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            n += len(how.compress(body[at : at + langid.PIECE]))
        return n

    def plain(text):
        if not any(unicodedata.category(c)[0] == "L" for c in text):
            return "und", 0.0
        for level in (langid.LEVEL, langid.FINE_LEVEL):
            n = [encoded(d, text, level) for _, d in model]
            if len(set(n)) == len(n):
                break
        least, second = sorted(n)[:2]
        return model[n.index(least)][0], 1 - least / second

    got = {r.doc_id: (r.lang_pred, round(r.score, 12)) for r in langid.identify(df).collect()}
    for d, text, _ in rows[::7] + odd:
        want = plain(text)
        assert got[d][1] == round(want[1], 12), (d, text)
        assert got[d][0] == want[0], (d, text)
    assert got[2000] == ("und", 0.0) and got[2001][0] != "und" and got[2002][0] != "und"


def test_long_labelled_texts_are_learned_from(spark):
    rows = [(i, " ".join(["haus", "fluss", "über", "nicht"] * 6000), "de") for i in range(6)] + [r for r in labelled()]
    df = spark.createDataFrame(rows + [(500, "nicht über haus", None)], "doc_id LONG, text STRING, lang STRING")
    assert {r.doc_id: r.lang_pred for r in langid.identify(df).collect()}[500] == "de"


# 2


def test_suffix_dedup(spark, tmp_path):
    got = tuples(suffixes.deduplicate(on_disk(spark, tmp_path)))
    assert keyed(got) == keyed(substrings(awkward()))


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    for _ in range(60):
        body = rng.integers(1, rng.integers(2, 6), rng.integers(2, 300)).astype(np.uint8)
        depth = int(rng.integers(9, 40))
        text = np.concatenate([np.tile(body[:9], 30) if rng.random() < 0.3 else body, np.zeros(depth + 16, np.uint8)])
        wanted = np.zeros(len(text), bool)
        wanted[: max(1, len(text) - 2 * depth - 16)] = True
        found = suffixes.suffix_array(text, wanted, depth)
        strings = [text[i : i + depth].tobytes() for i in found]
        assert sorted(found) == np.flatnonzero(wanted).tolist() and strings == sorted(strings)


def test_suffix_dedup_of_a_long_text(spark, tmp_path):
    piece = " ".join(f"v{i * 31337 % 99991}" for i in range(40))
    rows = [(1, " ".join(f"l{i * 7919 % 50021}" for i in range(180_000)) + piece), (2, piece)]  # longer than a chunk
    assert keyed(tuples(suffixes.deduplicate(on_disk(spark, tmp_path, rows)))) == keyed(substrings(rows))


def test_copies_are_not_sent(spark, tmp_path, monkeypatch):
    """Of copies in other blocks only what lies around their edits is sent, once for each kind."""
    from sylvaframe.llm import windows as jobs

    rng = np.random.default_rng(4)
    texts = [" ".join(f"c{x}" for x in rng.integers(0, 10**6, 120)) for _ in range(40)]
    rows = [(i * 1000 + k, t) for i in range(8) for k, t in enumerate(texts)]
    edited = [(d, t[:400] + f"!{d}!" + t[400:] if d % 7 == 3 else t) for d, t in rows]
    log, plain = str(tmp_path / "sent"), suffixes.answer

    def answer(asked):
        with open(log, "a") as f:
            f.write(f"{sum(len(a[2]) for a in asked)}\n")
        return plain(asked)

    monkeypatch.setattr(suffixes, "answer", answer)
    monkeypatch.setattr(jobs, "spread", lambda docs, each: 8 if each == jobs.PART_BYTES else 16)
    sent = []
    for table in (rows, edited):
        open(log, "w").close()
        assert keyed(tuples(suffixes.deduplicate(on_disk(spark, tmp_path, table)))) == keyed(substrings(table))
        sent.append(sum(map(int, open(log))))
    size = sum(len(t) for _, t in rows)
    assert sent[0] == 0 < sent[1] < size / 4  # about 4 times the size where every block sends all of its repeated contexts


def test_screened_contexts():
    from sylvaframe.llm import windows as jobs

    tag, whole = np.array([7, 7, 7, 5, 5, 9], np.uint32), np.array([1, 2, 1, 4, 4, 4], np.uint64)
    ids, docs, starts = np.array([3, 9, 2, 1, 1, 0]), np.zeros(6, np.int32), np.array([0, 0, 0, 8, 6, 0])
    later, asked = jobs.screened(tag, whole, (ids, docs, starts))
    assert later.tolist() == [True, False, False, True, False, False] and asked.tolist() == [False, True, True, False, False, False]
    assert [len(x) for x in jobs.screened(tag[:0], whole[:0], (ids[:0], docs[:0], starts[:0]))] == [0, 0]
    numbers = np.array([-(2**63), -1, 0, 300, 2**62])
    assert jobs.from_planes([jobs.planes(numbers[:2]), jobs.planes(numbers[2:])], np.int64).tolist() == numbers.tolist()


def test_shuffle_files_are_given_back(spark, tmp_path):
    import time

    from sylvaframe.llm.env import cut, freeing

    files, name = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = files().size(), spark.conf.get(name)
    with freeing(spark):
        assert cut(spark.range(1000).groupBy(F.col("id") % 7).count()).count() == 7
    end = time.time() + 20
    while files().size() > before and time.time() < end:
        time.sleep(0.1)
    assert files().size() <= before and spark.conf.get(name) == was


# 3


def test_token_output(spark, tmp_path):
    got = tuples(dac.round_trip(on_disk(spark, tmp_path)))
    want = reference_tokens(order(awkward()))
    assert sorted(n for _, _, n, _ in got) == sorted(len(ids) for _, ids in want)
    assert keyed((d, n, c) for d, _, n, c in got) == keyed((d, len(ids), crc(ids)) for d, ids in want)
    at = 0
    for d, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    assert [d for d, *_ in sorted(got, key=lambda r: r[1])] == [d for d, _ in want]


def test_direct_access():
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(0, 2**k, 700).astype(np.uint32) for k in (1, 8, 9, 16, 17, 32)])
    rng.shuffle(ids)
    data = dac.to_bytes([5, None], [ids[:1000].tobytes(), ids[1000:].tobytes()])
    codes = dac.Codes(data)
    places = rng.integers(0, len(ids), 5000)
    assert (codes.at(places) == ids[places]).all() and (codes.doc(1) == ids[1000:]).all() and len(codes) == len(ids)
    for a, b in ((0, 0), (3, 3), (511, 513), (0, len(ids)), (1023, 1025)):
        assert (codes.between(a, b) == ids[a:b]).all()


def test_encoding_equals_whole_text_encoding():
    rng = np.random.default_rng(0)
    bits = [" ", "  ", "   ", "\n", "\t", "a", "B", "The", "'s", "'re", "'", "1", "²", "é", "ß", "×", "—", "\xa0", "\x1c", "中", "🙂", "_", "-", ".", "<|endoftext|>", "ſ", "\x00", "½"]
    rows = [(i, "".join(rng.choice(bits, rng.integers(0, 12)))) for i in range(3000)]
    rows += [(k, f"{a}<|endoftext|>{b}") for k, (a, b) in enumerate((a, b) for a in ("", "a", "a ", "don't ", "  ", "é.") for b in ("", "b", " b", "  b c ", "'s", "|>", "<|endoftext|>", " <|endoftext"))]
    assert 50256 in dict(reference_tokens([(0, "a <|endoftext|> b")]))[0]
    encode = tokens.encoder(tokens.default_path()).encode
    for (_, t), (_, ids) in zip(rows, reference_tokens(rows)):
        assert np.frombuffer(encode(t), "<u4").tolist() == ids


# 4


def test_url_filter(spark, monkeypatch):
    hosts = ["example\x01foo.org", "\x01org", "a\x00.example.org", "example\x00.org", "a.\U0010ffffb.org", "foo\x01", "example.org\x01", "example.org", "a.example.org", "org", "xorg", "com", "b.com", "net", "", "EXAMPLE.ORG", "example.org.net"]
    paths = ["", "/", "/es/", "/es/x", "/en/1", "/en/12", "/en/2", "/fr/", "/de/a", "/de", "/fr/?q", "/de/#f", "?x=/de/"]
    rows = [(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)] + [(900, None), (901, ""), (902, "no scheme/de/"), (903, "http://b.com/de/"), (903, "http://b.com/de/"), (None, "x://org/a://b")]
    df = spark.createDataFrame(rows, "page_id LONG, url STRING").withColumn("path", F.lit(0))

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(h + p), len(h), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[2:] if fits else (None, "allow")))

    want = sorted(((i, *judge(u)) for i, u in rows), key=str)
    assert sorted(tuples(urls.judge(df, urls.rule_table(spark))), key=str) == want
    assert sorted(tuples(urls.judge(df, urls.rule_table(spark), parts=17)), key=str) == want
    monkeypatch.setattr(urls, "MOST_RANGES", 3)  # several parts share a range
    assert sorted(tuples(urls.judge(df, urls.rule_table(spark), parts=17)), key=str) == want
    assert urls.judge(df.limit(0), urls.rule_table(spark)).count() == 0


# 5


def test_jaccard_join(spark, tmp_path):
    rows = own_ids(awkward())
    assert sorted(tuples(join.components_of(on_disk(spark, tmp_path, rows)))) == jaccard(rows)


def test_jaccard_join_finds_every_link(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for size in (6, 12, 40, 120):
        for _ in range(25):
            base = [f"w{x}" for x in rng.integers(0, 400, size)]
            for _ in range(int(rng.integers(1, 6))):
                words = list(base)
                for _ in range(int(rng.integers(0, max(2, size // 20)))):
                    words[int(rng.integers(0, size))] = f"m{rng.integers(0, 50)}"
                rows.append((k, " ".join(words)))
                k += 1
    assert sorted(tuples(join.components_of(on_disk(spark, tmp_path, rows)))) == jaccard(rows)


@pytest.mark.parametrize("listed, size", [(-1, 1024), (-1, 3), (4, 2), (1 << 40, 1024)])
def test_long_lists_give_the_same_links(spark, tmp_path, monkeypatch, listed, size):
    monkeypatch.setattr(join, "LISTED", listed)
    monkeypatch.setattr(join, "OPEN", size)
    rng = np.random.default_rng(4)
    base, rows = [f"w{i}" for i in range(100)], []
    for k in range(60):  # one large group of half-similar texts
        words = list(base)
        for i in rng.choice(100, int(rng.integers(0, 5)), replace=False):
            words[i] = f"m{k}x{i}"
        rows.append((k, " ".join(words)))
    want = jaccard(rows)
    assert 1 < len({c for _, _, c in want}) < 60
    assert sorted(tuples(join.components_of(on_disk(spark, tmp_path, rows)))) == want


def test_keeping_one_of_each_group(spark, tmp_path):
    df = on_disk(spark, tmp_path)
    kept = join.keep_one(df)
    assert kept.columns == df.columns
    own = {d: c for d, _, c in jaccard(own_ids(awkward()))}
    got = Counter(r.doc_id for r in kept.collect())
    assert all((got[d] == 1) == (c == d) for d, c in own.items())
    assert got[None] == 2 and got[2] == got[3] == got[4] == 1


@pytest.mark.parametrize("each", [1_000_000, 40])
def test_components_of_a_long_chain(spark, monkeypatch, each):
    monkeypatch.setattr(components, "CONTRACTED", each)
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a LONG, b LONG")
    got = dict(tuples(components.components(links)))
    assert {got[i] for i in range(201)} == {0} and got[501] == 500


# 6


def test_packing(spark, tmp_path):
    df = on_disk(spark, tmp_path)
    got = packing.pack(df).toPandas()
    ids = reference_tokens(awkward())
    assert got.length.sum() == sum(len(x) for _, x in ids)
    places = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert places.length.sum().max() <= packing.CAPACITY
    assert all((g.offset.values == g.length.cumsum().values - g.length.values).all() for _, g in places)
    assert {d for d, _ in ids if d is not None} == {int(d) for d in got.doc_id.dropna()} and got.doc_id.isna().sum() == 2
    long = next(x for d, x in ids if d == 22)
    for _, r in got[got.doc_id == 22].iterrows():
        assert crc(long[int(r.start) : int(r.start) + int(r.length)]) == r.ids_crc32 and (r.length == 1024 or r.piece == 0)


def best(sizes, cap):
    """The fewest bins, by trying everything."""
    sizes, least = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, bins):
        if len(bins) >= least[0]:
            return
        if i == len(sizes):
            least[0] = len(bins)
            return
        for k in {bins[k]: k for k in range(len(bins)) if bins[k] + sizes[i] <= cap}.values():
            go(i + 1, bins[:k] + [bins[k] + sizes[i]] + bins[k + 1 :])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return least[0]


def test_bin_completion_is_optimal_on_small_cases():
    rng = np.random.default_rng(5)
    for _ in range(60):
        cap = int(rng.integers(10, 40))
        sizes = rng.integers(1, cap + 1, rng.integers(1, 13)).tolist()
        counts = np.bincount(sizes, minlength=cap + 1)
        plan = packing.plan(counts)
        assert all(sum(x) <= cap for x, _ in plan)
        assert Counter(x for f, n in plan for _ in range(n) for x in f) == Counter(sizes)
        assert sum(n for _, n in plan) == best(sizes, cap)
        assert packing.lower_bound(counts) <= best(sizes, cap)


def test_bin_completion_of_short_pieces_is_better_than_best_fit():
    counts = np.zeros(1025, np.int64)
    counts[30:101] = np.random.default_rng(0).integers(1, 2000, 71)
    plan = packing.plan(counts)
    used = sum(n for _, n in plan)
    assert used == packing.lower_bound(counts) < sum(n for _, n in packing.best_fit(counts))
    assert (sum(n * np.bincount(f, minlength=1025) for f, n in plan) == counts).all() and max(sum(f) for f, _ in plan) <= 1024


def test_fillings_are_all_the_maximal_ones():
    rng = np.random.default_rng(6)
    for _ in range(40):
        counts = np.bincount(rng.integers(1, 31, 9), minlength=31)
        first = int(np.flatnonzero(counts)[-1])
        pieces = np.repeat(np.arange(31), counts).tolist()
        pieces.remove(first)
        want, room = set(), 30 - first
        for chosen in range(1 << len(pieces)):
            inside = tuple(sorted((x for k, x in enumerate(pieces) if chosen >> k & 1), reverse=True))
            outside = [x for k, x in enumerate(pieces) if not chosen >> k & 1]
            if sum(inside) <= room and all(x > room - sum(inside) for x in outside):
                want.add(inside)
        for price in (None, 0.5, 12):
            got = [f for f in packing.fillings(counts, first, price) if f is not None]
            assert len(got) == len(set(got)) and set(got) == want
        least = min((room - sum(f) + 3 * len(f) for f in want))  # among the maximal ones, which a cheaper one may be filled up to
        found = packing.cheapest(np.bincount(pieces, minlength=31), room, 3)
        assert found in want and room - sum(found) + 3 * len(found) <= least + 3 * len(found)


def test_a_price_for_pieces_keeps_small_ones_for_large_bins():
    counts = np.zeros(101, np.int64)
    counts[[90, 89, 72, 11, 9, 5, 4]] = [3, 1, 2, 1, 3, 2, 2]
    have = counts.copy()
    have[90] -= 1
    assert packing.cheapest(have, 10, 0.1) == (5, 5) and packing.cheapest(have, 10, 3) == (9,)


# 7


def test_media(spark, tmp_path):
    df = on_disk(spark, tmp_path)
    got = media.round_trip(df)

    def want(d, t):
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64) if b else bytes(64)
        m = media.to_wav(p)
        return (d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), media.features(p))

    assert keyed(tuples(got)) == keyed(want(d, t) for d, t in awkward())
    assert media.round_trip(df.limit(0)).count() == 0


def test_media_members_are_retried_by_themselves(spark, tmp_path, monkeypatch):
    path = scratch(spark, "retry")
    media.write(on_disk(spark, tmp_path), path)
    reader = media.ArchiveReader(path, 1 << 30)
    part = next(p for p in reader.partitions() if p.spans[0][1] == 0)
    whole = [b.to_pydict() for b in reader.read(part)]

    class Flaky:
        def __init__(self, f):
            self.f, self.fails = f, 2

        def seek(self, n):
            return self.f.seek(n)

        def read(self, n):
            if self.fails:
                self.fails -= 1
                raise OSError("lost")
            return self.f.read(n)

    import zipfile

    store, root = media._store(path)
    with store.open_input_file(f"{root}/{part.spans[0][0]}") as f:
        m = sorted(zipfile.ZipFile(f).infolist(), key=lambda m: m.header_offset)[0]
        got = media.ArchiveReader.member(Flaky(f), m.header_offset, m.compress_size, m.file_size, m.CRC, wait=0)
        assert got == whole[0]["media"][0]
        with pytest.raises(OSError, match="damaged"):
            media.ArchiveReader.member(f, m.header_offset, m.compress_size, m.file_size, m.CRC ^ 1, wait=0)
    small = media.ArchiveReader(path, 256)
    assert sum(len(b) for p in small.partitions() for b in small.read(p)) == len(awkward())
    parts = len(small.partitions())
    monkeypatch.setattr(media, "MOST_TASKS", 3)
    few = small.partitions()
    assert len(few) < parts and sum(len(b) for p in few for b in small.read(p)) == len(awkward())


def test_media_appends(spark, tmp_path):
    path = scratch(spark, "appends")
    for rows in ([(1, "first")], [(2, "second"), (3, None)], []):
        media.write(on_disk(spark, tmp_path, rows), path)
    assert sorted(r.doc_id for r in media.read(spark, path).collect()) == [1, 2, 3]
    store, root = media._store(path)
    from pyarrow import fs

    before = {i.base_name for i in store.get_file_info(fs.FileSelector(root))}
    writer = media.ArchiveWriter(path)
    with store.open_output_stream(f"{root}/left.zip") as f:
        f.write(b"x")
    writer.abort([media.Written([["left.zip", 1]]), None])
    assert {i.base_name for i in store.get_file_info(fs.FileSelector(root))} == before


def test_media_features_by_hand():
    assert media.features(bytes([128] * 64)) == "n=64;mean=0.000000;rms=0.000000;zcr=0.000000;hist=0,0,64,0"
    assert media.features(bytes([0, 255] * 32)) == "n=64;mean=-0.500000;rms=127.500980;zcr=1.000000;hist=32,0,0,32"
    assert media.to_wav(b"ab")[:4] == b"RIFF" and media.to_wav(b"ab")[20:24] == b"\x01\x00\x01\x00" and media.to_wav(b"ab")[34:36] == b"\x08\x00" and media.to_wav(b"ab")[44:] == b"ab"
    import io
    import wave

    with wave.open(io.BytesIO(media.to_wav(b"abcd"))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getnframes(), w.readframes(4)) == (1, 1, 4, b"abcd")


# 8


def test_substring_dedup(spark, tmp_path):
    got = tuples(factors.deduplicate(on_disk(spark, tmp_path)))
    assert keyed(got) == keyed(windows(awkward()))


def test_factors_copy_the_words_of_their_sources(spark, tmp_path):
    split = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in own_ids(awkward())}
    passage = " ".join(f"s{i}" for i in range(200)).split()
    split |= {100 + k: [f"o{k}x{i}" for i in range(20)] + passage[k * 10 :] + [f"e{k}x{i}" for i in range(20)] for k in range(5)} | {200: passage + passage[50:120], 201: passage}
    rows = [(d, " ".join(w)) for d, w in split.items()]
    gone = {d: set() for d in split}
    for r in factors.factorize(on_disk(spark, tmp_path, rows)).collect():
        assert r.n_words == len(split[r.doc_id])
        for f in r.factors:
            assert f.words >= 35 and (f.source, f.source_start) != (r.doc_id, f.start)
            assert split[r.doc_id][f.start : f.start + f.words] == split[f.source][f.source_start : f.source_start + f.words]
            gone[r.doc_id] |= set(range(f.start, f.start + f.words))
        if r.doc_id in (1, 5):  # copies are one factor each
            assert [(f.start, f.words) for f in r.factors] == [(0, len(split[r.doc_id]))]
    assert {d: len(x) for d, x in gone.items()} == {d: n for d, _, n, _ in windows(rows)}


def twins(letters):
    """A Thue-Morse word over a and b, and its complement: their sums of powers are equal whatever the base."""
    bits = [bin(i).count("1") & 1 for i in range(letters)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_words_with_equal_sums_are_different(spark, tmp_path):
    a, b = twins(1024)
    left, right = " ".join(f"l{i}" for i in range(20)), " ".join(f"r{i}" for i in range(20))
    rows = [(1, f"{left} {a} {right}"), (2, f"{left} {b} {right}"), (3, a), (4, b), (5, " ".join(twins(2048)[0])), (6, " ".join(twins(2048)[1])), (7, twins(4096)[0]), (8, twins(4096)[1])]
    want = windows(rows)
    assert want[0][2] == want[1][2] == 0
    df = on_disk(spark, tmp_path, rows)
    assert keyed(tuples(factors.deduplicate(df))) == keyed(want)
    assert sorted(tuples(join.components_of(df))) == jaccard(rows)
    assert keyed(tuples(suffixes.deduplicate(df))) == keyed(substrings(rows))


def test_hashes_tell_contents_apart():
    from sylvaframe.llm import windows as jobs

    rng = np.random.default_rng(2)
    runs = sorted({bytes(rng.integers(0, 3, int(n)).astype(np.uint8)) for n in rng.integers(0, 40, 3000)} | {bytes(n) for n in range(0, 2100, 7)})
    data, last = np.frombuffer(b"".join(runs), np.uint8), np.cumsum([len(r) for r in runs])
    first = last - [len(r) for r in runs]
    assert len(set(jobs.byte_hash(data, first, last).tolist())) == len(runs)
    again = np.append(np.frombuffer(b"zzz", np.uint8), data)
    assert (jobs.byte_hash(again, first + 3, last + 3) == jobs.byte_hash(data, first, last)).all()
    values = rng.integers(0, 2, 3000).astype(np.uint64)
    for n in (1, 2, 5, 8, 35):
        runs = [values[i : i + n].tobytes() for i in range(len(values) - n + 1)]
        at = np.arange(len(runs))
        for found in (jobs.chained(values, at, np.full(len(at), n)), jobs.rolled(values, n)):
            assert len(set(zip(runs, found.tolist()))) == len(set(runs)) == len(set(found.tolist()))


def solved(head: bytes, total: int, n: int, rng):
    """Pairs of 16 printable bytes that, after ``head`` (whole eights) in a run of ``total`` bytes, leave the hash alike under the key that this process has."""
    from sylvaframe.llm import windows as jobs

    U = np.uint64
    one = np.array([total], U) * U(3) + jobs.KEY["offset"]
    state = jobs.keyed(one)
    for j in range(0, len(head), 8):
        state = jobs.keyed(state ^ np.frombuffer(head[j : j + 8], "<u8"))
    out = []
    while len(out) < n:
        a, b = (rng.integers(33, 127, (200_000, 8)).astype(np.uint8).view("<u8").ravel() for _ in range(2))
        x = rng.integers(33, 127, (200_000, 8)).astype(np.uint8).view("<u8").ravel()
        y = x ^ jobs.keyed(state ^ a) ^ jobs.keyed(state ^ b)
        text = y.view(np.uint8).reshape(-1, 8)
        for k in np.flatnonzero(((text >= 33) & (text < 127)).all(axis=1) & (a != b)):
            out.append((bytes(np.array([a[k], x[k]]).view(np.uint8)).decode(), bytes(np.array([b[k], y[k]]).view(np.uint8)).decode()))
    return out[:n]


def test_texts_made_to_collide_are_told_apart(spark, tmp_path):
    """Collisions solved for one key are none under the key of a run."""
    from sylvaframe.llm import windows as jobs

    rng = np.random.default_rng(11)
    words = [("~t-MfF^ge>l)w#{u", 'tA"g~#EE>zclk,Dj'), ('hq"q@^e4}$3;a<)$', "3y(!w&o1+')@.j@5"), *solved(b"", 16, 20, rng)]
    for a, b in words[2:]:
        data = np.frombuffer((a + b).encode(), np.uint8)
        assert len(set(jobs.byte_hash(data, np.array([0, 16]), np.array([16, 32])).tolist())) == 1  # under this process's key
    rows = []
    for k, (a, b) in enumerate(words):
        left, right = (" ".join(f"{side}{k}x{i}" for i in range(20)) for side in "lr")
        rows += [(10 * k, f"{left} {a} {right}"), (10 * k + 1, f"{left} {b} {right}"), (10 * k + 2, f"{a} b c d"), (10 * k + 3, f"{b} b c d")]
    df = on_disk(spark, tmp_path, rows)
    want = windows(rows)
    assert not any(r[2] for r in want)
    assert keyed(tuples(factors.deduplicate(df))) == keyed(want)
    assert sorted(tuples(join.components_of(df))) == jaccard(rows)
    head, tail = "the same forty bytes before what differs", "and the same forty-four bytes after it, always."[:44]
    texts = [(k, head + x + tail) for k, x in enumerate(y for pair in solved(head.encode(), 100, 20, rng) for y in pair)]
    assert {len(t) for _, t in texts} == {100} and len({t for _, t in texts}) == 40
    want = substrings(texts)
    assert keyed(tuples(suffixes.deduplicate(on_disk(spark, tmp_path, texts)))) == keyed(want) and not any(r[2] for r in want)


def around_a_phrase(kind):
    """Texts with a common phrase, whose hash is small enough to be their windows' minimizer, between words of their own, some of which are repeated."""
    from sylvaframe.llm import windows as jobs

    def small(phrase):
        data = np.frombuffer(phrase.encode(), np.uint8)
        units = jobs.BYTE_CODE[data] if kind == "bytes" else jobs.words(data, np.array([0, len(data)]))[0]
        return int(jobs.run_hash(jobs.sums(units), np.array([0]), np.array([len(units)]))[0])

    shape = "common phrase number {:011d}" if kind == "bytes" else "common{} b c d e f g h"  # one minimizer long
    phrase = min(map(shape.format, range(2000)), key=small)
    own = lambda k, side: " ".join(f"{side}{x}" for x in np.random.default_rng(k).integers(0, 10**6, 40))
    rng = np.random.default_rng(8)
    return [(int(i), f"{own(k, 'a')} {phrase} {own(k + 1000 * int(rng.integers(0, 2)), 'b')}") for i, k in enumerate(rng.integers(0, 2000, 400))]


@pytest.mark.parametrize("module, brute", [(suffixes, substrings), (factors, windows)])
def test_a_common_minimizer_is_split(spark, tmp_path, monkeypatch, module, brute):
    from sylvaframe.llm import windows as jobs

    monkeypatch.setattr(jobs, "HOT", 20)
    plain, log = module.answer, str(tmp_path / "parts")

    def answer(asked):
        with open(log, "a") as f:
            f.write(f"{sum(len(x) for a in asked for x in a[:1])}\n")
        return plain(asked)

    monkeypatch.setattr(module, "answer", answer)
    monkeypatch.setattr(jobs, "new_key", lambda: bytes(32))  # the phrase is small under this key
    jobs.seal(bytes(32))
    rows = around_a_phrase("bytes" if module is suffixes else "words")
    df = on_disk(spark, tmp_path, rows)
    monkeypatch.setattr(jobs, "spread", lambda docs, each: 8 if each == jobs.PART_BYTES else 16)
    assert keyed(tuples(module.deduplicate(df))) == keyed(brute(rows))
    sizes = [int(x) for x in open(log)]
    assert max(sizes) < sum(sizes) / 4  # 8 parts
    monkeypatch.setattr(jobs, "HOT", 2)
    assert keyed(tuples(module.deduplicate(on_disk(spark, tmp_path)))) == keyed(brute(awkward()))


@pytest.mark.parametrize("module, brute", [(suffixes, substrings), (factors, windows)])
def test_a_phrase_of_all_documents_is_summed_up(spark, tmp_path, monkeypatch, module, brute):
    """A part gets one entry for each block of a minimizer that all documents have, and no sum has more than the entries of its few blocks."""
    from sylvaframe.llm import windows as jobs

    rows = [(i, " ".join(f"u{i}x{j}" for j in range(20)) + " " + " ".join(f"same{j}" for j in range(40)) + " " + " ".join(f"v{i}x{j}" for j in range(20))) for i in range(1500)]
    df = on_disk(spark, tmp_path, rows)
    log, plain = str(tmp_path / "sums"), jobs.told

    def told(fp, b, times):
        with open(log, "a") as f:
            f.write(f"{len(fp)} {len(plain(fp, b, times)[0])}\n")
        return plain(fp, b, times)

    told.__module__ = "__main__"  # so that it travels to the workers
    monkeypatch.setattr(jobs, "told", told)
    asked = []
    monkeypatch.setattr(jobs, "spread", lambda docs, each: asked.append(each) or (96 if len(asked) == 1 else 8))
    monkeypatch.setattr(jobs, "SUMMED_BLOCKS", 8)
    assert keyed(tuples(module.deduplicate(df))) == keyed(brute(rows))
    sizes = [tuple(map(int, x.split())) for x in open(log)]
    common = [(a, b) for a, b in sizes if a > 2 * b]  # the phrase's: many entries, few pairs of minimizer and block
    assert len(common) >= 12 and max(a for a, _ in common) < sum(a for a, _ in common) / 4


def test_told_sums_entries():
    from sylvaframe.llm import windows as jobs

    fp, b, times = jobs.told(np.array([5, 5, 3, 5, 3], np.uint64), np.array([1, 0, 2, 1, 2], np.int32), np.array([1, 1, 2, 3, 1]))
    assert list(zip(fp.tolist(), b.tolist(), times.tolist())) == [(3, 2, 3), (5, 0, 1), (5, 1, 4)]
    assert [len(x) for x in jobs.told(fp[:0], b[:0], times[:0])] == [0, 0, 0]


# 9


def test_exact_dedup(spark, tmp_path):
    rows = awkward() + [(100 + i, "hot") for i in range(300)]
    for bits in (26, 6):  # a filter that is full sends every row the long way, with the same result
        got = tuples(exact.exact_duplicates(on_disk(spark, tmp_path, rows), log2_bits=bits))
        assert len(got) == len(rows)
        groups = Counter(t or "" for _, t in rows)
        sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
        top = {t: max((d for d, x in rows if (x or "") == t and d is not None), default=None) for t in groups}
        assert all((k, n) == (top[sha[h]], groups[sha[h]]) for _, k, n, _, h in got)
        assert sum(r[3] for r in got) == len(groups) and all(d == k for d, k, _, kept, _ in got if kept)
        kept = exact.drop_exact_duplicates(on_disk(spark, tmp_path, rows), log2_bits=bits)
        assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((d is None, d or 0, sha[h]) for d, _, _, k, h in got if k)
        assert kept.columns == frame(spark).columns


def test_deduplication_of_rows_in_another_order_at_each_scan(spark, tmp_path):
    rows = own_ids(awkward()) + [(200 + i, f"copy {i % 40} of a text that is long enough to count") for i in range(200)] + [(500, "tie")] * 3

    def stirred(batches):  # as a scan that is cut into other parts
        import os

        import pyarrow as pa

        table = pa.Table.from_batches(list(batches))
        yield from table.take(pa.array(np.random.default_rng(int.from_bytes(os.urandom(8))).permutation(len(table)))).to_batches()

    plain = on_disk(spark, tmp_path, rows, 1)
    df = plain.mapInArrow(stirred, plain.schema)
    groups = Counter(t or "" for _, t in rows)
    top = {t: max(d for d, x in rows if (x or "") == t) for t in groups}
    assert sorted((d, k, n) for d, k, n, _, _ in tuples(exact.exact_duplicates(df))) == sorted((d, top[t or ""], groups[t or ""]) for d, t in rows)
    assert sorted(r[0] for r in tuples(exact.exact_duplicates(df)) if r[3]) == sorted(top.values())
    assert sorted((r.doc_id, r.text or "") for r in exact.drop_exact_duplicates(df).collect()) == sorted((d, t) for t, d in top.items())
    single = [r for r in rows if r[0] != 500]
    df = plain.filter("doc_id != 500").mapInArrow(stirred, plain.schema)
    assert sorted(tuples(join.components_of(df))) == jaccard(single)


# 10


def test_mixing(spark, tmp_path):
    rng = np.random.default_rng(0)
    sources = ["b", "a", None, "Z", "é", "empty"]
    rows = [(i, None if s == "empty" else " ".join(["w"] * int(rng.integers(1, 60))), s) for i in range(3000) for s in [sources[min(5, int(rng.exponential(1.2)))]]]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING").withColumn("weight", F.lit(0))
    got = mixing.mixed(df).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, free, left = {}, set(names), sum(size.values())
    while True:  # share again until none is above
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 3 * size[s]}
        if not above:
            target |= share
            break
        for s in above:
            target[s] = 3 * size[s]
            left -= 3 * size[s]
        free -= above
    by = {d: s for d, _, s in rows}
    taken = Counter()
    for r in got:
        assert r.source_size == size[by[r.doc_id]] and abs(r.target - target[by[r.doc_id]]) < 1e-6 and r.taken <= 3 * r.size
        taken[by[r.doc_id]] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s]
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixed(df.repartition(7)).collect()))
    copies = Counter(r.doc_id for r in mixing.emit(df).collect())
    assert all(copies[r.doc_id] * r.size == r.taken for r in got) and mixing.emit(df).columns == df.columns


# 11


def ranked(rows, items, k=10):
    """Scores of every document for every item by plain loops."""
    import math

    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = lambda t: term.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    docs = [(d, Counter(low(t))) for d, t in rows]
    n, total = sum(bool(c) for _, c in docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in docs:
            m = 25 + (75 * c.total() * n) // total if total else 25
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in low(text) if c[t])
            if score > 0:
                found.append((-score, d is not None, d or 0))
        out += [(item, k_ + 1, d if known else None, -s) for k_, (s, known, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def test_ranked_search(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = [f"Word{i}" for i in range(60)] + ["the"] * 20 + ["Ünï", "中文", "a1b2"]
    texts = [" ".join(rng.choice(vocabulary, int(rng.integers(1, 40)))) for _ in range(300)]
    rows = awkward() + [(100 + i, t) for i, t in enumerate(texts)] + [(900 + i, texts[0]) for i in range(30)]  # ties
    asked = [(i, " ".join(rng.choice(vocabulary, 8))) for i in range(30)] + [(50, None), (51, ""), (52, " ... "), (53, "nowhere"), (54, "the THE the"), (55, texts[0]), (55, "word1"), (None, "word2 word3"), (56, "w1x1 don t x 中文-ünï")]
    items = spark.createDataFrame(asked, "item_id LONG, text STRING").withColumn("rank", F.lit(1))
    df = on_disk(spark, tmp_path, rows)
    assert sorted(tuples(search.search(df, items)), key=str) == ranked(rows, asked)
    monkeypatch.setattr(search, "BLOCK", 16)
    monkeypatch.setattr(search, "CHUNK", 4)
    monkeypatch.setattr(search, "REMEMBERED", 5)
    assert sorted(tuples(search.search(df, items, k=3)), key=str) == ranked(rows, asked, 3)
    assert search.search(df, items.limit(0)).count() == search.search(df.limit(0), items).count() == 0


def test_accumulators_stop(monkeypatch):
    """Common terms make no accumulators where they can't bring a document among the best; the answer is the same."""
    rng = np.random.default_rng(6)
    n = 2000
    block = search.Search(np.arange(n), np.zeros(n, np.uint8), np.full(n, 50), n, 50 * n)
    lists = {b"rare": np.arange(40), b"mid": np.sort(rng.choice(n, 300, False)), b"all": np.arange(n)}
    for k, (t, docs) in enumerate(lists.items()):
        block.add(t, len(docs), [5000, 1500, 3][k], docs.astype("<u2"), rng.integers(1, 5, len(docs)))
    made, plain = [], np.partition
    monkeypatch.setattr(search.np, "partition", lambda x, k: made.append(len(x)) or plain(x, k))
    at, scores = block.best([(b"all", 1), (b"rare", 2), (b"mid", 1)], 10)
    total = np.zeros(n, np.int64)
    for t, times in ((b"all", 1), (b"rare", 2), (b"mid", 1)):
        total[block.gains[t][1]] += block.gains[t][2] * times
    want = np.lexsort((np.arange(n), -total))[:10]
    assert at.tolist() == want.tolist() and scores.tolist() == total[want].tolist()
    assert max(made[:2]) < 400  # of 2000 documents, all of which have a term


# 12


def merkle_rows(rows, tampered):
    """The tree by plain recursion, whole levels at a time."""
    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(r):
        return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
        return out

    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels([e[2] for e in sorted(by[x], key=lambda e: e[:3])]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    out = []
    for n, x in enumerate(langs):
        for k, (_, _, own, r) in enumerate(sorted(by[x], key=lambda e: e[:3])):
            folded, proof = leaf(tampered(r)), ""
            for tree, at in ((trees[x], k), (top, n)):
                for level in tree[:-1]:
                    other = level[at ^ 1] if at ^ 1 < len(level) else ""
                    folded = h(other, folded) if at & 1 else h(folded, other)
                    proof += other
                    at >>= 1
            out.append((r[0], own, trees[x][-1][0], top[-1][0], h(proof), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def test_merkle_manifest(spark, tmp_path):
    rows = awkward() + [(1000 + i, f"text {i}") for i in range(150)] + [(5000, "same")] * 3
    df = on_disk(spark, tmp_path, rows).withColumn("lang", F.when(F.col("doc_id") == 7, "Ünï").otherwise(F.col("lang")))
    plain = [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    change = lambda r: r if r[0] is None or r[3] is None or zlib.crc32(str(r[0]).encode()) % 7 else (*r[:3], r[3] + 1, r[4])
    want = merkle_rows(plain, change)
    assert sum(not r[-1] for r in want) > 10
    assert sorted(tuples(merkle.audited(df)), key=str) == want
    for bits in (1, 2, 3):  # rounds of small blocks, also among the keys' roots
        got = merkle.manifest(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, {"n_chars": F.col("n_chars") + 1}, bits=bits)
        assert sorted(tuples(got), key=str) == want, bits
    assert {r.verified for r in merkle.manifest(df).collect()} == {True}
    many = df.withColumn("lang", F.concat(F.lit("l"), (F.col("doc_id") % 37).cast("string")))
    plain = [tuple(r) for r in many.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = merkle.manifest(many, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, {"n_chars": F.col("n_chars") + 1}, bits=2)
    assert sorted(tuples(got), key=str) == merkle_rows(plain, change)


def test_versions_share_what_is_untouched():
    digests = [hashlib.sha256(bytes([k])).digest() for k in range(11)]
    tree = merkle.plant(digests, 4)
    for place in range(11):
        version = merkle.put(tree, 4, place, b"x" * 32)
        old, new, copied = tree, version, 0
        for k in reversed(range(4)):
            side, other = ("right", "left") if place >> k & 1 else ("left", "right")
            assert old is not new and getattr(old, other) is getattr(new, other)
            old, new, copied = getattr(old, side), getattr(new, side), copied + 1
        assert copied == 4 and new.digest == b"x" * 32 and old.digest == digests[place]
        assert merkle.fold(b"x" * 32, merkle.path(tree, 4, place)) == version.digest != tree.digest
        assert merkle.fold(digests[place], merkle.path(tree, 4, place)) == tree.digest


# 13


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())


def spelled(own, text):
    return np.frombuffer(own.encode(text), "<i4").tolist()


def test_pieces_equal_the_library():
    own, sp, rng = pieces.Model(pieces.default_path()), library(), np.random.default_rng(1)
    names = list(own.ids)
    letters = list("abcdeéß中文🙂́\n\t\x00\x01  ▁..,<>0x12AtheinerΩж")
    texts = ["", " ", "  ", "▁", "<s>", "</s><unk>", "<0x0A>", " a", "a ", "a  b", "a" * 5000, "ab" * 3000, " " * 3000, "▁t" * 2000]
    for _ in range(3000):
        texts.append("".join(rng.choice(names, int(rng.integers(1, 8)))))
        texts.append("".join(rng.choice(letters, int(rng.integers(1, 30)))))
        texts.append("".join(rng.choice([" ", "  ", "a", "t", "the", " " * 17], int(rng.integers(1, 9)))))
    texts += [t.replace("▁", " ") for t in texts]
    for t in texts:
        assert spelled(own, t) == sp.encode(t), t


def test_backtracking_gives_what_merging_gives():
    """Also where a longest piece leads into a dead end, and where a worker forgets."""
    own = pieces.Model(pieces.default_path())
    rng = np.random.default_rng(2)
    names = [n for n in own.ids if 2 < len(n) < 7]
    dead_ends = 0
    for _ in range(4000):
        text = "".join(rng.choice(names, 3))
        got = own.backtrack(text)
        assert got == own.merge(text)
        longest = max((n for n in (text[:k] for k in range(1, len(text) + 1)) if n in own.ids), key=len, default=text[0])
        dead_ends += got[0] != longest
    assert dead_ends > 50


@pytest.mark.parametrize("slots, taken, long", [(1 << 20, 4_000_000, 63), (4, 200, 63), (1 << 20, 10, 3)])
def test_pieces_of_many_texts_equal_the_library(monkeypatch, slots, taken, long):
    """Also where few answers fit the table, texts are taken by few, and parts are too long to be solved with others."""
    for name, value in (("SLOTS", slots), ("TAKEN", taken), ("LONG", long)):
        monkeypatch.setattr(pieces, name, value)
    own, sp, rng = pieces.Model(pieces.default_path()), library(), np.random.default_rng(3)
    names = [n.replace("▁", " ") for n in own.ids]
    letters = list("abcdeéß中文🙂́\n\t\x00\x01  ▁..,<>0x12AtheinerΩж")
    texts = [None, "", " ", "a", " a", "a ", "a  b", "▁", "a▁b", "\x00", "a\x00b c", "🙂 🙂", "x" * 300, "ab " * 500]
    for _ in range(300):
        texts.append("".join(rng.choice(names, int(rng.integers(1, 30)))))
        texts.append("".join(rng.choice(letters, int(rng.integers(1, 60)))))
        texts.append(" ".join("".join(rng.choice(names, 3)).strip() or "x" for _ in range(4)))
    for some in (texts, texts[:1], texts[:2], [], texts[2:3] * 3, texts):
        ids, counts = own.encode_all(some)
        want = [sp.encode(t or "") for t in some]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [k for x in want for k in x]


def test_each_new_part_is_solved_once_and_with_others(monkeypatch):
    """A word is one part whatever marks follow it; it is not searched again for each of them, nor by itself."""
    own, solved = pieces.Model(pieces.default_path()), []
    inner = own.together
    monkeypatch.setattr(own, "together", lambda parts: solved.append(parts) or inner(parts))
    monkeypatch.setattr(own, "backtrack", None)
    marks = [".", ",", ";", "!", "?", ").", "\n", ":", "..."]
    texts = [" ".join(w + m for w in ("thandonerwhat", "esenwhor", "Undeiniester")) for m in marks]
    own.encode_all(texts)
    own.encode_all(texts[::-1])
    assert len(solved) == 1 and sorted(solved[0]) == sorted({"▁thandonerwhat", "▁esenwhor", "▁Undeiniester", *marks})


def test_sentencepiece_round_trip(spark, tmp_path):
    rows, sp = awkward(), library()
    want = []
    for d, t in rows:
        ids = sp.encode(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    df = on_disk(spark, tmp_path)
    assert sorted(tuples(pieces.round_trip(df)), key=str) == sorted(want, key=str)
    decoded = {r.doc_id: (r.ids, r.text) for r in pieces.decode(pieces.encode(df.filter("doc_id < 19 OR doc_id > 19"))).collect()}
    assert all(decoded[d] == (sp.encode(t or ""), t or "") for d, t in own_ids(rows))


# all


NAMES = "row kept found _f _row _sha _hash _maybe _hot _s0 _w0 _r0 _h0 _size _source_size _source _target _copies _copy _kept col mixed_source whole part pick source_size target slot node".split()


@pytest.mark.parametrize("stage", [langid.keep_identified, exact.drop_exact_duplicates, join.keep_one, mixing.emit])
def test_stages_keep_columns_of_any_name(spark, tmp_path, stage):
    plain = on_disk(spark, tmp_path).drop("node")
    df = plain.select("*", *(F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in NAMES))
    got = stage(df)
    assert got.columns == df.columns
    rows = got.collect()
    assert rows and all(r[n] == f"{n} {'none' if r.doc_id is None else r.doc_id}" for r in rows for n in NAMES)
    assert sorted((r.doc_id or 0, r.text or "") for r in rows) == sorted((r.doc_id or 0, r.text or "") for r in stage(plain).collect())


def test_empty_tables(spark, tmp_path):
    none = on_disk(spark, tmp_path, [])
    for f in (langid.identify, suffixes.deduplicate, dac.round_trip, join.components_of, packing.pack, media.round_trip, factors.deduplicate, exact.exact_duplicates, mixing.mixed, exact.drop_exact_duplicates, join.keep_one, mixing.emit, langid.keep_identified, merkle.audited, pieces.round_trip):
        assert f(none).count() == 0, f


def test_only_nulls(spark, tmp_path):
    rows = [(None, None)] * 3
    for f in (langid.identify, suffixes.deduplicate, dac.round_trip, join.components_of, packing.pack, media.round_trip, factors.deduplicate, exact.exact_duplicates, mixing.mixed, merkle.audited, pieces.round_trip):
        assert f(on_disk(spark, tmp_path, rows)).count() == 3, f
