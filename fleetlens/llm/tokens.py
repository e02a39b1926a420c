"""Encoding whole texts piece by piece, each distinct piece once per worker.

No token crosses a cut, so a text costs one dictionary lookup per piece. Where the tokenizer
drops white space, a text is cut at single spaces and before line feeds. Where it keeps white
space, a piece is a run without white space, with one space before it if there is one, or white
space by the byte-level rule: a run gives its last character up to the text behind it, and that
character is a piece of its own unless it is the space. A piece that is one Latin word with at
most a comma or full stop behind it goes straight to the tokenizer's merge model; every other
piece goes through the whole tokenizer.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cache
from operator import itemgetter

from tokenizers import Tokenizer

CACHED = 300_000
LONGEST = 64
LONG_TEXT = 1 << 22
_PLAIN = re.compile(r"(\n?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
_SPACED = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
# The characters with the Unicode property White_Space.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]")


@cache
def encoder(path: str) -> Tokenizer:
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@cache
def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where printable, else the next free one above 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def cut(text: str) -> list[str]:
    """Pieces of a text; all but the first stand for a space and themselves unless they open with a line feed."""
    return text.replace("\n", " \n").split(" ")


def spaced_pieces(text: str) -> Iterable[str]:
    """Pieces of a text that together are the text, white space included."""
    if len(text) > LONG_TEXT:  # the same pieces, without a list of them
        return map(itemgetter(0), _PIECE.finditer(text))
    return _PIECE.findall(text)


class _Bounded(dict):
    """Keeps the first ``limit`` answers; frequent pieces come early."""

    def __init__(self, path: str, limit: int = CACHED, base: dict | None = None):
        super().__init__(base or {})
        self.limit = limit + len(self)
        self.tokenizer = encoder(path)
        self.model = self.tokenizer.model

    def __missing__(self, piece: str):
        found = self.answer(piece)
        if len(self) < self.limit and len(piece) <= LONGEST:
            self[piece] = found
        return found

    def merged(self, word: str) -> list:
        letters = byte_letters()
        return self.model.tokenize("".join(map(letters.__getitem__, word.encode())))

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class WordIds(_Bounded):
    """Ids of a text under a lower-casing tokenizer that drops white space, as little-endian uint32 bytes."""

    def __init__(self, path: str, limit: int = CACHED):
        super().__init__(path, limit)
        self.words: dict[str, bytes] = {}

    def answer(self, piece: str) -> bytes:
        plain = _PLAIN.fullmatch(piece)
        if not plain:
            return self.packed(self.ids(piece))
        return self.word(plain[2].lower()) + (self.word(plain[3]) if plain[3] else b"")

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = self.packed([t.id for t in self.merged(word)])
            if len(self.words) < self.limit:
                self.words[word] = found
        return found

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, cut(text)))


class ByteCounts(_Bounded):
    """Token counts of a text under a byte-level tokenizer that keeps white space.

    Special strings are cut out first, as the library does; each is one token.
    """

    def __init__(self, path: str, limit: int = CACHED, base: dict | None = None):
        super().__init__(path, limit, base)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("special strings that take white space or need word bounds are not supported")
        names = sorted((t.content for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None

    def answer(self, piece: str) -> int:
        plain = _SPACED.fullmatch(piece)
        if plain:
            return len(self.merged(plain[1])) + len(plain[2])
        return len(self.ids(piece))

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return sum(sum(map(self.__getitem__, spaced_pieces(part))) for part in parts) + len(parts) - 1
