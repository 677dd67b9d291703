"""Token ids of whole texts by a public tokenizer, inside Spark tasks.

A byte-level BPE encodes each pre-token (a word with its leading space, a run of digits, of marks, of white space)
by itself. A worker therefore cuts a text at single spaces, where pre-tokens always begin, and remembers the ids of
what lies between; what it has not met it splits with the tokenizer's own pattern and hands each pre-token to the
tokenizer's model. A text that holds the string of an added token goes to the tokenizer as it is. ``tests/llm`` compares
the ids with those of whole-text encoding.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

END = 2
#: Pieces that a worker remembers newly before it forgets those that it has not met since the last time.
REMEMBERED = 150_000
MARKS = frozenset(".,!?;:")
#: Texts of other characters than these are split with the full pattern: here letters, digits and spaces are the classes below.
PLAIN = re.compile("[^\t\n\r -~À-ſ]")
SPLIT = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ſ]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\t\n\r 0-9A-Za-zÀ-ÖØ-öø-ſ]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")


def byte_letters() -> dict[int, int]:
    """The letters by which a byte-level model writes the 256 bytes: printable ones as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}


class Known(dict):
    """What a function gave for a key, computed once while the key is met now and then."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class Encoder:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole, self.letters = Tokenizer.from_file(path), byte_letters()
        self.model = self.whole.model
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.any = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.words, self.pieces = Known(self.word), Known(self.piece)

    def word(self, word: str) -> bytes:
        """The ids of one pre-token."""
        return array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def piece(self, piece: str) -> bytes:
        """The ids of what stands after a space: mostly a word, or a word and a mark."""
        if piece.isalpha() and (piece.isascii() or not PLAIN.search(piece)):
            return self.word(" " + piece)
        if piece[-1:] in MARKS and piece[:-1].isalpha() and not PLAIN.search(piece):
            return self.pieces[piece[:-1]] + self.words[piece[-1]]
        return self.plain(" " + piece)

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, (self.any if PLAIN.search(text) else SPLIT).findall(text)))

    def encode(self, text: str | None, end: int | None = END) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; null is an empty text."""
        text = text or ""
        if any(t in text for t in self.added):
            ids = array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        elif "  " in text or text[-1:].isspace():  # runs of white space reach over a cut
            ids = self.plain(text)
        else:
            first, *rest = text.split(" ")
            ids = self.plain(first) + b"".join(map(self.pieces.__getitem__, rest))
        return ids if end is None else ids + end.to_bytes(4, "little")


@lru_cache(2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
