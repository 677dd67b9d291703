"""Substring deduplication on words by relative Lempel-Ziv parsing.

``windows.find`` brings the contexts of repeated minimizers together; each part is a reference block. The part indexes all of
it, every run of ``LENGTH`` words in sorted order, and parses its contexts against it greedily: at the cursor, the longest
match that begins at a neighbour in the index becomes a factor, with the place where its words stand; the cursor moves on by one word
if there is none. After a factor the cursor goes back to the first window that reaches over its end. A context that occurs more than once
is one factor, a copy of its first occurrence (which copies another one).

The documents' blocks put the factors together. The windows of a document are divided among its contexts, so whatever straddles
the border of two factors is a window of its own and was looked up by itself; factors that go on at the place where the one before ended
are joined. So every document is written as factors, long runs of words that stand elsewhere too, and the words between. Factors of ``LENGTH``
words and more are duplicate spans.

A context is at most 62 words around a minimizer, and a document's contexts go to the blocks of their minimizers: a document meets
only those reference blocks that can have one of its windows, not every block.

Every copy goes: a word is removed if a window over it has the same words as one that starts anywhere else. Words are
compared by 64-bit hashes of their bytes with a secret key of the run (``windows.byte_hash``), one by one over a factor's whole length.

Defined cases: a null, empty or blank text has no words; windows never reach over documents; texts of fewer than
``LENGTH`` words keep all; rows that share an id, and repeated rows, count as separate documents; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from . import windows
from .windows import U64

LENGTH, GRAM = 35, 8
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
SPANS = "doc_id long, n_words long, factors array<struct<start:long,words:long,source:long,source_start:long>>"
#: What a part replies: windows ``at``..``at + n - 1`` of a context copy those from word ``pos`` of document ``doc`` on; OWN: see ``located``.
FACTOR = np.dtype([("context", "<i4"), ("at", "<i2"), ("n", "<i2"), ("doc", "<i8"), ("pos", "<i8")])
OWN = -1


def ask(block: windows.Block, c: windows.Contexts, first: np.ndarray, count: np.ndarray) -> tuple[bytes, ...]:
    a, b = c.first[first], c.last[first] + LENGTH
    at = np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange(int((b - a).sum()))
    doc = np.searchsorted(block.at, a, "right") - 1
    keys = np.stack([c.fp[first], c.whole[first]], axis=1)
    more = np.stack([count, block.doc_ids[doc], a - block.at[doc]], axis=1).astype(np.int64)
    return keys.tobytes(), (c.last[first] - a + 1).astype(np.int32).tobytes(), block.hashes[at].tobytes(), more.tobytes()


def parse(words: np.ndarray, begin: np.ndarray, windows_of: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, ...]:
    """Parses the contexts ``which`` (words from ``begin``, so many windows each) against all of them: for each factor its context, first window
    and number of windows, and the context and window that it copies."""
    n = windows_of
    end = begin + n + LENGTH - 1
    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))  # where each window starts
    print_of = windows.rolled(words, LENGTH)[at] if len(at) else np.zeros(0, U64)
    ctx = np.repeat(np.arange(len(n)), n)
    # the index: windows by fingerprint, then by the words after them, so that neighbours match longest
    after = np.stack([words[np.minimum(at + LENGTH + j, len(words) - 1)] * (at + LENGTH + j < end[ctx]) for j in (1, 0)])
    index = np.lexsort((after[0], after[1], print_of))
    slot = np.empty(len(index), np.int64)
    slot[index] = np.arange(len(index))
    base = np.cumsum(n) - n
    cursor, live = np.zeros(len(n), np.int64), which[n[which] > 0]
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 5]
    while len(live):
        w = base[live] + cursor[live]
        best, source = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        for side in (-1, 1):
            to = slot[w] + side
            ok = (to >= 0) & (to < len(index))
            mate = index[np.clip(to, 0, len(index) - 1)]
            ok &= print_of[mate] == print_of[w]
            rows = np.flatnonzero(ok)
            x, y = at[w[rows]], at[mate[rows]]
            room = np.minimum(end[live[rows]] - x, end[ctx[mate[rows]]] - y)
            length, going = np.zeros(len(rows), np.int64), np.arange(len(rows))
            while len(going):
                going = going[length[going] < room[going]]
                going = going[words[x[going] + length[going]] == words[y[going] + length[going]]]
                length[going] += 1
            longer = length > best[rows]
            best[rows[longer]], source[rows[longer]] = length[longer], mate[rows[longer]]
        factor = best >= LENGTH
        inner = np.where(factor, best - LENGTH + 1, 0)  # windows inside the factor
        found.append((live[factor], cursor[live[factor]], inner[factor], ctx[source[factor]], source[factor] - base[ctx[source[factor]]]))
        cursor[live] += np.where(factor, inner, 1)
        live = live[cursor[live] < n[live]]
    return tuple(np.concatenate(x) for x in zip(*found))


def answer(asked: list[tuple[bytes, ...]]) -> list[bytes]:
    """The factors of every context asked about."""
    keys = np.frombuffer(b"".join(a[0] for a in asked), U64).reshape(-1, 2)
    n = np.frombuffer(b"".join(a[1] for a in asked), np.int32).astype(np.int64)
    words = np.frombuffer(b"".join(a[2] for a in asked), U64)
    count, doc, pos = np.frombuffer(b"".join(a[3] for a in asked), np.int64).reshape(-1, 3).T
    size = n + LENGTH - 1
    begin = np.cumsum(size) - size
    order = np.lexsort((keys[:, 1], keys[:, 0]))  # stable: of equal contexts, the first that was asked about leads
    new = np.ones(len(order), bool)
    new[1:] = np.any(keys[order[1:]] != keys[order[:-1]], axis=1)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    lead, size_of = order[starts], np.diff(np.append(starts, len(order)))
    total = np.bincount(kind, count, len(starts)).astype(np.int64)
    # contexts that occur more than once: each is a copy of the leading one, and that of the next, or of another one of its block
    many = np.flatnonzero(total[kind] > 1)
    source = lead[kind[many]]
    leads = source == many
    second = order[np.minimum(starts + 1, len(order) - 1)][kind[many]]
    apart = size_of[kind[many]] > 1
    source = np.where(leads, np.where(apart, second, OWN), source)
    copies = np.zeros(len(many), FACTOR)
    copies["context"], copies["n"] = many, n[many]
    copies["doc"], copies["pos"] = np.where(source >= 0, doc[source], 0), np.where(source >= 0, pos[source], OWN)
    # the others are parsed
    own, at, inner, mate, offset = parse(words, begin[lead], n[lead], np.flatnonzero(total == 1))
    parsed = np.zeros(len(own), FACTOR)
    parsed["context"], parsed["at"], parsed["n"] = lead[own], at, inner
    parsed["doc"], parsed["pos"] = doc[lead[mate]], pos[lead[mate]] + offset
    every = np.concatenate([copies, parsed])
    every = every[np.argsort(every["context"], kind="stable")]
    out, j = [], 0
    for a in asked:
        to = j + len(a[1]) // 4
        lo, hi = np.searchsorted(every["context"], [j, to])
        mine = every[lo:hi].copy()
        mine["context"] -= j
        out.append(mine.tobytes())
        j = to
    return out


def located(block: windows.Block, c: windows.Contexts | None, replies) -> tuple[np.ndarray, ...]:
    """The factors of the block's documents, in order, neighbours joined: (first word in the block, words, source document, word there)."""
    none = np.zeros(0, np.int64)
    if c is None or not len(c.first):
        return none, none, none, none
    answers, first, kind_of, _ = replies
    found = [np.zeros(0, FACTOR)]
    for i, data in answers:
        one = np.frombuffer(data, FACTOR).copy()
        one["context"] = i[one["context"]]
        found.append(one)
    factors = np.concatenate(found)
    factors = factors[np.lexsort((factors["at"], factors["context"]))]
    # each context has the factors of its kind
    edges = np.searchsorted(factors["context"], np.arange(len(first) + 1))
    many = np.diff(edges)[kind_of]
    ctx = np.repeat(np.arange(len(kind_of)), many)
    mine = factors[edges[kind_of[ctx]] + np.arange(len(ctx)) - np.repeat(np.cumsum(many) - many, many)]
    start, n = c.first[ctx] + mine["at"], mine["n"].astype(np.int64)
    doc, pos = mine["doc"].copy(), mine["pos"].copy()
    # of a kind's contexts all but the first copy the first; so does that one if the kind is in no other block, from the last
    last = np.zeros(len(first), np.int64)
    last[kind_of] = np.arange(len(kind_of))
    leads = first[kind_of[ctx]] == ctx
    inside = ~leads | (pos == OWN)
    other = c.first[np.where(leads, last[kind_of[ctx]], first[kind_of[ctx]])[inside]]
    home = np.searchsorted(block.at, other, "right") - 1
    doc[inside], pos[inside] = block.doc_ids[home], other - block.at[home] + mine["at"][inside]
    order = np.argsort(start, kind="stable")
    start, n, doc, pos = start[order], n[order], doc[order], pos[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1] + n[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + n[:-1])
    at = np.flatnonzero(fresh)
    return start[at], (np.add.reduceat(n, at) if len(at) else none) + LENGTH - 1, doc[at], pos[at]


def apply(block: windows.Block, c: windows.Contexts | None, replies):
    """Of each document, how many words lie in factors, and a digest of the others."""
    import pyarrow as pa

    start, words_of, _, _ = located(block, c, replies)
    step = np.zeros(int(block.at[-1]) + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, start + words_of, -1)
    gone = np.cumsum(step[:-1]) > 0
    before = np.append(0, np.cumsum(gone))
    removed = before[block.at[1:]] - before[block.at[:-1]]
    digests, view = [], memoryview(block.data)
    for d in range(len(block)):
        words = bytes(view[block.byte_at[d] : block.byte_at[d + 1]]).split()
        if removed[d]:
            words = [w for w, g in zip(words, gone[block.at[d] : block.at[d + 1]].tolist()) if not g]
        digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
    return pa.table([pa.array(block.doc_ids, mask=block.null), pa.array(np.diff(block.at).astype(np.int64)), pa.array(removed), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def listed(block: windows.Block, c: windows.Contexts | None, replies):
    """Of each document, its factors: (first word, words, source document, first word there)."""
    import pyarrow as pa

    start, words_of, source, source_start = located(block, c, replies)
    doc = np.searchsorted(block.at, start, "right") - 1
    edges = np.searchsorted(doc, np.arange(len(block) + 1))
    fields = [pa.array(x) for x in (start - block.at[doc], words_of, source, source_start)]
    factors = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "words", "source", "source_start"]))
    return pa.table([pa.array(block.doc_ids, mask=block.null), pa.array(np.diff(block.at).astype(np.int64)), factors], names=["doc_id", "n_words", "factors"])


def deduplicate(docs: DataFrame) -> DataFrame:
    return windows.find(docs, "words", LENGTH, GRAM, ask, answer, apply, SCHEMA)


def factorize(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, factors: list of (start, words, source, source_start)) of every row: the runs of at least ``LENGTH`` words that also stand
    in another place, and where. A null source id is shown as the smallest 64-bit integer."""
    return windows.find(docs, "words", LENGTH, GRAM, ask, answer, listed, SPANS)
