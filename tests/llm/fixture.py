"""A small table with the awkward cases, and brute-force versions of the operators."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, word STRING, count LONG, node LONG"  # the last three clash with inner names
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"w{i % 97}x{i}" for i in range(160))
OTHER = " ".join(f"q{i}" for i in range(60))


def awkward():
    """(doc_id, text): nulls, empty and blank texts, repeated rows, near copies, shared passages, a long text."""
    passage = " ".join(f"p{i}" for i in range(50))
    near = BASE.split()
    near[80] = "changed"
    far = [w if i % 3 else f"z{i}" for i, w in enumerate(BASE.split())]
    texts = [
        (1, BASE), (2, None), (3, ""), (4, " \t\n "), (5, BASE), (6, " ".join(near)), (7, "Héllo wörld"), (8, "hÉLLO wörld"), (9, "one"), (10, "One"), (11, OTHER + " " + passage),
        (12, passage + " " + OTHER[:40]), (13, BASE.upper()), (14, " ".join(far)), (15, "a" * 400), (16, ("ab " * 90).strip()), (17, "\u00a0".join(["x", "y"]) + "\x1cz"), (18, "🙂 " + "ß" * 120), (19, "tie tie"), (19, "tie tie"), (19, "other text"), (None, "no id"), (None, None),
        (20, (OTHER + "  ") * 3), (21, "<|endoftext|> it's 12 don't   x"), (22, " ".join(f"l{i * 7919 % 5003}" for i in range(30000))), (23, "1234 5678 !!"), (24, "<|endoftext|>"), (25, "a<|endoftext|> b <|endoftext|>"),
    ]
    return texts


def frame(spark, rows=None):
    rows = awkward() if rows is None else rows
    return spark.createDataFrame([(d, t, ("en", "fr", None)[k % 3], ("a", "b", None, "c")[k % 4], None if t is None else len(t), "w", 1, 2) for k, (d, t) in enumerate(rows)], SCHEMA)


def on_disk(spark, tmp_path, rows=None, parts=3):
    path = str(tmp_path / f"documents-{len(list(tmp_path.iterdir()))}")
    frame(spark, rows).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


def lower(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def substrings(rows, n=100):
    """Each row's (bytes, removed, runs, digest), in the order of ``order``."""
    seen, out = set(), []
    for d, t in order(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if b[i : i + n] in seen:
                gone[i : i + n] = b"\x01" * n
            seen.add(b[i : i + n])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def windows(rows, n=35):
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    seen = Counter(tuple(w[i : i + n]) for _, w in split for i in range(len(w) - n + 1))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard(rows):
    """(doc_id, n, component) of rows with ids of their own."""
    sets, up = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), root(d)) for d in ids)


def own_ids(rows):
    """The rows whose id no other has."""
    n = Counter(d for d, _ in rows)
    return [(d, t) for d, t in rows if d is not None and n[d] == 1]


def reference_tokens(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [(d, [*model.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows]


def mixed(rows, seeds=64):
    """How often each of (doc_id, source, text) is taken: plain versions of the shares, rates, draws and the choice among the seeds."""
    import math

    sizes = [len(WORD.findall(t or "")) for _, _, t in rows]
    size = Counter()
    for (_, s, _), n in zip(rows, sizes):
        size[s] += n
    names = sorted(s for s in size if s is not None) + [None] * (None in size)
    weight, target, free, left = {s: k % 3 + 1 for k, s in enumerate(names)}, {}, set(names), sum(size.values())
    while True:  # share again until none is above
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] >= 3 * size[s]}
        if not above:
            target |= share
            break
        for s in above:
            target[s] = 3.0 * size[s]
            left -= 3 * size[s]
        free -= above
    copies = [0] * len(rows)
    for s in names:
        rate = target[s] / size[s] if size[s] else 1.0
        whole, part = math.floor(rate), math.floor((rate - math.floor(rate)) * 2**32)
        mine = [(k, hashlib.md5(f"{'null' if rows[k][0] is None else rows[k][0]}|mix-1".encode()).hexdigest()) for k in range(len(rows)) if rows[k][1] == s]
        draw = [(k, int(h[:8], 16), int(h[8:16], 16)) for k, h in mine]
        tried = [[whole + ((a + seed * b) % 2**32 < part) for _, a, b in draw] for seed in range(seeds)]
        near = min(range(seeds), key=lambda x: (abs(sum(n * sizes[k] for n, (k, _, _) in zip(tried[x], draw)) - target[s]), x))
        for n, (k, _, _) in zip(tried[near], draw):
            copies[k] = n
    return copies, target


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def keyed(found):
    out = defaultdict(list)
    for r in found:
        out[r[0]].append(tuple(r[1:]))
    return {k: sorted(v, key=str) for k, v in out.items()}
