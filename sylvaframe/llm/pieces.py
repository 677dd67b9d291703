"""SentencePiece encoding and decoding of whole texts, with the merges of a BPE model found by backtracking.

The library starts from single characters and always merges the adjacent pair whose text is the piece of the highest score, the
leftmost of equals. The result is the one sequence of pieces in which every two neighbours are compatible: merging their
joined text anew gives these two again. ``Model.backtrack`` finds it from left to right: at each place it tries the longest piece that
begins there (all of them come from one Aho-Corasick pass), then ever shorter ones, keeps the first that is compatible with the
piece before, and where none is, marks the place as failed in a bitfield and takes the piece before back. A place fails at most
once, so the work is linear in the text.

A text is cut first where no piece of the model can reach across: characters that pieces have side by side are of one class (letters, marks, ...), and a
part is a run of one class, for most models with the space before it. So a word has one entry whatever marks follow it; a worker remembers the ids of the parts
that it has met lately. ``Model.together`` backtracks in all new parts of some texts at once, a step of each at a time, in arrays. ``tests/llm`` compares the ids with the
library's.

Models: BPE with byte fallback, no text normalisation but the white space marks, no user-defined pieces; others are a
ValueError. Texts are decoded by the library's own ``decode(ids)``.

Defined cases: a null or empty text has no ids and decodes to an empty text; ids of documents may be null or repeat, each row is a
row of the result; control pieces written out in a text are plain text; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .env import ready

#: Fixed values of the model format: kinds of piece, and the mark of a space.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
SPACE = "▁"
NONE = float("-inf")
REMEMBERED = 300_000
#: Compatibilities of pairs of pieces that a worker remembers.
PAIRS = 400_000
#: Slots of the table that arrays look them up in (a power of two), bits for the number of a piece or character, and the longest part that is solved with others.
SLOTS, BITS, LONG = 1 << 20, 22, 63
#: Characters of the texts, and parts, that are taken at once.
TAKEN, PARTS = 2_000_000, 15_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield key >> 3, data[at : at + size]
        at += size


class Recent(dict):
    """What a function gave for a key; keys not met among the last ``REMEMBERED`` to ``2 * REMEMBERED`` new ones are forgotten."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        got = self.old.get(key)
        return self.put(key, self.make(key) if got is None else got)

    def put(self, key: str, got: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class Model:
    def __init__(self, path: str):
        import ahocorasick
        import numpy as np

        with open(path, "rb") as f:
            fields = list(message(f.read()))
        pieces = [{1: b"", 2: bytes(4), 3: NORMAL} | dict(message(v)) for k, v in fields if k == 1]
        trainer, rules = (dict(message(next((v for k, v in fields if k == n), b""))) for n in (2, 3))
        if trainer.get(3) != 2 or not trainer.get(35) or rules.get(2) or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1):
            raise ValueError("not a BPE model with byte fallback and plain white space marks")
        if any(p[3] not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in pieces):
            raise ValueError("the model has user-defined or unused pieces")
        names = [p[1].decode() for p in pieces]
        self.ids = {name: k for k, (name, p) in enumerate(zip(names, pieces)) if p[3] == NORMAL}
        self.score = {name: struct.unpack("<f", pieces[k][2])[0] for name, k in self.ids.items()}
        self.byte_ids = [names.index(f"<0x{b:02X}>") for b in range(256)]
        self.apart = not any("\0" in x for x in self.ids if len(x) > 1)  # whether this character keeps parts apart
        self.codes = {name: struct.pack("<i", k) for name, k in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for name in self.ids:
            if len(name) > 1:
                self.automaton.add_word(name, self.ids[name])
        self.automaton.make_automaton()
        self.parts = self.shape()
        self.pairs: dict[str, dict[str, bool]] = {}
        self.met = 0
        self.names, self.sizes = names, np.array([len(name) for name in names])
        self.single = np.arange(len(names), len(names) + 0x110000)  # of each character; one that is no piece has a number beyond the pieces
        for name, k in self.ids.items():
            if len(name) == 1:
                self.single[ord(name)] = k
        self.table = np.zeros(SLOTS, np.int64)
        self.units = Recent(self.unit)

    def shape(self) -> re.Pattern:
        """What a part of a text is: a run of characters of one class, or one that no piece has beside another; spaces stand before a part if none can follow others in a piece."""
        inside = {name[k : k + 2] for name in self.ids for k in range(len(name) - 1)}
        self.at_words = at_words = not any(x[1] == SPACE != x[0] for x in inside)
        group = {c: {c} for x in inside for c in x if not (at_words and c == SPACE)}
        for a, b in inside:
            if a in group and b in group and group[a] is not group[b]:
                group[a] |= group[b]
                for c in group[b]:
                    group[c] = group[a]
        classes = [f"[{''.join(map(re.escape, sorted(g)))}]+" for g in sorted({id(g): g for g in group.values()}.values(), key=len, reverse=True)]
        if at_words:
            return re.compile(f"{SPACE}*(?:{'|'.join([*classes, f'[^{SPACE}]'])})|{SPACE}+")
        return re.compile("|".join([*classes, "."]), re.DOTALL)

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by the merges themselves."""
        parts, score = list(text), self.score
        scores = [score.get(a + b, NONE) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > NONE:
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = score.get(parts[k - 1] + parts[k], NONE)
            if k < len(scores):
                scores[k] = score.get(parts[k] + parts[k + 1], NONE)
        return parts

    def compatible(self, before: str, piece: str) -> bool:
        """Whether merging the joined text gives these two again; ``before`` is empty at the start of a text."""
        if self.met >= PAIRS:
            self.pairs.clear()
            self.met = 0
        self.met += 1
        found = self.pairs.setdefault(before, {})[piece] = self.merge(before + piece) == ([before, piece] if before else [piece])
        return found

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a text, and single characters that are none."""
        begin = [[c] for c in text]  # the pieces that begin at each place, ascending
        for end, k in self.automaton.iter(text):
            piece = self.names[k]
            begin[end - len(piece) + 1].append(piece)
        failed = bytearray(len(text) // 8 + 1)
        out: list[str] = []
        at, before, below, size = 0, "", len(text) + 1, len(text)
        while at < size:
            known = self.pairs.get(before, {})
            for piece in reversed(begin[at]):
                fits = known.get(piece)
                if self.compatible(before, piece) if fits is None else fits:
                    end = at + len(piece)
                    if end - at < below and not failed[end >> 3] >> (end & 7) & 1:
                        out.append(piece)
                        at, before, below = end, piece, size + 1
                        break
            else:  # no piece goes on from here: the one before ends elsewhere
                failed[at >> 3] |= 1 << (at & 7)
                below = len(out.pop())
                at -= below
                before = out[-1] if out else ""
        return out

    def name(self, k: int) -> str:
        """The text of a piece, or of a character that is none, by its number; that before a text is -1."""
        return "" if k < 0 else self.names[k] if k < len(self.names) else chr(k - len(self.names))

    def fit(self, before, piece):
        """``compatible`` for arrays of numbers; ``table`` keeps the last answer of each slot."""
        import numpy as np

        key = (before + 1 << BITS) | piece
        slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - SLOTS.bit_length())
        found = self.table[slot]
        new = np.flatnonzero(found >> 1 != key)
        if len(new):
            asked, back = np.unique(key[new], return_inverse=True)
            answers = []
            for k in asked.tolist():
                a, b = self.name((k >> BITS) - 1), self.name(k & (1 << BITS) - 1)
                known = self.pairs.get(a, {}).get(b)
                answers.append(k << 1 | (self.compatible(a, b) if known is None else known))
            found[new] = self.table[slot[new]] = np.array(answers)[back]
        return found & 1 == 1

    def together(self, parts: list[str]) -> list[bytes]:
        """The ids of some parts, by ``backtrack`` in all of them at once: each turn of the loop tries a piece for each part."""
        import numpy as np

        text = "\0".join([*parts, ""])
        ends = np.cumsum([len(part) + 1 for part in parts]) - 1
        many = np.fromiter(self.automaton.iter(text), [("end", np.int64), ("piece", np.int64)])
        size = self.sizes[many["piece"]]
        alone = self.single[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        # by place, longest first: a place, the size from above, a number
        order = np.sort(np.concatenate([(many["end"] - size + 1 << 7 | 127 - size) << BITS | many["piece"], (np.arange(len(text)) << 7 | 126) << BITS | alone]))
        piece, size = order & (1 << BITS) - 1, 127 - (order >> BITS & 127)
        first = np.searchsorted(order, np.arange(len(text) + 1) << 7 + BITS)
        failed, chosen, back, last = np.zeros(len(text) + 1, bool), *np.full((3, len(text) + 1), -1)
        at = np.concatenate([[0], ends[:-1] + 1])
        trial, stop = first[at], ends
        while len(at):
            spent = trial == first[at + 1]
            if spent.any():  # no piece goes on from here: the one before ends elsewhere
                failed[at[spent]] = True
                at[spent] = back[at[spent]]
                trial[spent] = chosen[at[spent]] + 1
            tried = np.flatnonzero(~spent)
            k, here = trial[tried], at[tried]
            end = here + size[k]
            good = ~failed[end]
            good[good] = self.fit(last[here[good]], piece[k[good]])
            trial[tried[~good]] += 1
            tried, k, here, end = tried[good], k[good], here[good], end[good]
            chosen[here], back[end], last[end] = k, here, piece[k]
            at[tried], trial[tried] = end, first[end]
            left = at < stop
            at, trial, stop = at[left], trial[left], stop[left]
        used, place, begin = np.zeros(len(text) + 1, bool), ends, np.concatenate([[0], ends[:-1] + 1])
        while len(place):
            used[place] = True
            place = back[place]
            place, begin = place[place > begin], begin[place > begin]
        place = np.flatnonzero(used)
        found = last[place]
        bounds = np.searchsorted(place, ends, "right").tolist()
        if found.max(initial=0) >= len(self.names):  # there are characters that are no pieces
            codes = [self.code(self.name(k)) for k in found.tolist()]
            return [b"".join(codes[a:b]) for a, b in zip([0, *bounds], bounds)]
        data = found.astype("<i4").tobytes()
        return [data[4 * a : 4 * b] for a, b in zip([0, *bounds], bounds)]

    def code(self, piece: str) -> bytes:
        """The id of a piece, or those of the bytes of a character that is none."""
        return self.codes.get(piece) or struct.pack(f"<{len(b := piece.encode())}i", *(self.byte_ids[x] for x in b))

    def unit(self, part: str) -> bytes:
        """The ids of a part."""
        return b"".join(map(self.code, [part] if len(part) == 1 else self.backtrack(part)))

    def cut(self, text: str) -> list[str]:
        """The parts of a text."""
        return self.parts.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit integers."""
        return b"".join(map(self.units.__getitem__, self.cut(text or "")))

    def encode_all(self, texts: list[str | None]) -> tuple:
        """The ids of all texts, and how many each has, as arrays; what is new in some of the texts is found together."""
        import numpy as np

        ids, counts, at = [np.empty(0, np.int32)], [np.empty(0, np.int64)], 0
        while at < len(texts):
            start, some = at, 0
            while at < len(texts) and (at == start or some + len(texts[at] or "") <= TAKEN):
                some += len(texts[at] or "")
                at += 1
            for out, got in zip((ids, counts), self.encode_some([t or "" for t in texts[start:at]])):
                out.append(got)
        return np.concatenate(ids), np.concatenate(counts)

    def encode_some(self, texts: list[str]) -> tuple:
        """``encode_all`` of texts that are taken at once. Words that single spaces separate are told apart by Arrow and cut once; any other text counts as one word."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = np.array([self.at_words and t != "" and "  " not in t and t[0] != " " != t[-1] and SPACE not in t for t in texts], bool)
        split = pc.split_pattern(pa.array([t for t, p in zip(texts, plain) if p], pa.string()), " ")
        words = split.flatten().dictionary_encode()
        parts = self.cut(" ".join(words.dictionary.to_pylist()))
        starts = [k for k, part in enumerate(parts) if part[0] == SPACE] if len(words.dictionary) else []
        for text, p in zip(texts, plain):
            if not p:
                starts.append(len(parts))
                parts += self.cut(text)
        flat, ends = self.known(parts)
        bounds = ends[np.array([*starts, len(parts)])]
        per_text = np.ones(len(texts), np.int64)
        per_text[plain] = np.diff(split.offsets.to_numpy())
        index = np.empty(per_text.sum(), np.int64)
        of_plain = np.repeat(plain, per_text)
        index[of_plain] = words.indices.to_numpy()
        index[~of_plain] = np.arange(len(words.dictionary), len(starts))
        ids, ends = gather(flat, bounds, index)
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(per_text)])])

    def known(self, parts: list[str]) -> tuple:
        """The ids of some parts in a row, and where each part's begin and the last one's end."""
        import numpy as np
        import pyarrow as pa

        different = pa.array(parts, pa.string()).dictionary_encode()
        names = different.dictionary.to_pylist()
        units, old = self.units, self.units.old
        new = [p for p in names if p not in units and p not in old]
        found: dict[str, bytes] = {}
        short = [p for p in new if len(p) <= LONG] if self.apart else []
        for k in range(0, len(short), PARTS):
            found.update(zip(short[k : k + PARTS], self.together(short[k : k + PARTS])))
        for part, got in found.items():
            units.put(part, got)
        codes = [found.get(p) or units[p] for p in names] if found else [units[p] for p in names]
        sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        return gather(np.frombuffer(b"".join(codes), "<i4"), np.concatenate([[0], np.cumsum(sizes)]), different.indices.to_numpy())


def gather(values, bounds, index) -> tuple:
    """The runs of ``values`` between two bounds that ``index`` names, in a row, and where each begins and the last one ends."""
    import numpy as np

    sizes = bounds[index + 1] - bounds[index]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.arange(ends[-1]) + np.repeat(bounds[index] - ends[:-1], sizes)], ends


@lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


@lru_cache(2)
def library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def encode(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids array<int>) for every row of ``docs``."""
    import pyarrow as pa

    ready(docs.sparkSession)
    path = path or default_path()

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        own = model(path)
        for batch in batches:
            ids, counts = own.encode_all(batch.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text) for every row of (doc_id, ids)."""
    import pyarrow as pa

    ready(encoded.sparkSession)
    path = path or default_path()

    def run(batches: Iterator) -> Iterator:
        own = library(path)
        for batch in batches:
            lists = batch.column("ids")
            ids, ends = lists.values.to_numpy(), lists.offsets.to_pylist()
            texts = [own.decode(ids[a:b].tolist()) if a < b else "" for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, from its ids and the text that they decode to."""
    return decode(encode(docs, path), path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )
