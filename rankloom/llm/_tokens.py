"""Token ids of whole texts by the tokenizers library, a piece of text at a time, with a bounded cache of pieces."""

from __future__ import annotations

import os
import re
from array import array
from itertools import repeat

import regex

#: Pieces that a worker remembers; then it starts afresh.
CACHED = 700_000
#: Longer pieces aren't remembered.
LONGEST = 64

# fixed values: what the two public vocabularies' pre-tokenisers match
BYTE_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

#: Pieces of these characters only are split here, with the same result and in less time; others by the library.
_PLAIN = re.compile(r"[\t\n\x20-\x7e\xa1-\xff]*")
#: Byte-level vocabularies write a byte as a character: itself where it is printable, else the next one from 256 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTES = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}

_before_word = re.compile(r" (?=[^ ])")


def byte_pieces(text: str) -> list[str]:
    """Pieces between which byte-level pre-tokenisers always cut: before a space that a non-space follows."""
    if "  " in text:
        first, *rest = _before_word.split(text)
    else:
        first, *rest = text.split(" ")
        if rest and not rest[-1]:  # a space at the very end follows the last word
            rest[-1:] = []
            return [first, *map("".join, zip(repeat(" "), rest)), " "] if rest or first else [" "]
    return [first, *map("".join, zip(repeat(" "), rest))]


def word_pieces(text: str) -> list[str]:
    """Pieces between which pre-tokenisers that drop white space always cut: at spaces and line breaks."""
    return text.replace("\n", " ").split(" ")


class Ids(dict):
    """Ids of texts as little-endian unsigned 32-bit integers, equal to those of encoding each whole text.

    As a dictionary it remembers the ids of pieces that it has met."""

    _known: dict[tuple, Ids] = {}

    def __init__(self, path: str, pieces):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = pieces
        # texts that may hold one of the vocabulary's added tokens are left to the library
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.I).search
        self.lower = pieces is word_pieces
        self.split = (WORD_PATTERN if self.lower else BYTE_PATTERN).findall
        self.model = self.tokenizer.model.tokenize
        self[""] = b""

    @classmethod
    def of(cls, path: str, pieces) -> Ids:
        """One for each worker process."""
        key = (path, pieces.__name__)
        if key not in cls._known:
            cls._known[key] = cls(path, pieces)
        return cls._known[key]

    def encode(self, texts: list[str]) -> list[bytes]:
        look = self.__getitem__
        return [self._library(t) if self.added(t) else b"".join(map(look, self.pieces(t))) for t in texts]

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        found = self._piece(piece)
        if len(piece) <= LONGEST:
            if len(self) >= CACHED:
                self.clear()
                self[""] = b""
            self[piece] = found
        return found

    def _piece(self, piece: str) -> bytes:
        """Pre-tokenised here where that is certain to agree; byte-pair encoding is always the library's."""
        if not (piece.isascii() and piece.isprintable() or _PLAIN.fullmatch(piece)):
            return self._library(piece)
        word = piece[1:] if piece[0] == " " else piece
        if word.isalpha():
            return self._part(piece)
        if word[:-1].isalpha() and word[-1] in ",.;:!?":
            return self[piece[:-1]] + self[word[-1]]
        if self.lower:
            piece = piece.lower()
        return b"".join([self._part(x) if x == piece else self[x] for x in self.split(piece)])

    def _part(self, part: str) -> bytes:
        if self.lower:
            part = part.lower()
        shown = part if part.isascii() and part.isalnum() else part.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.model(shown)]).tobytes()
