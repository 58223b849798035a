"""Words of whole UTF-8 texts, found and hashed with numpy over Arrow buffers, many documents at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that are handled at a time; a longer document is handled alone.
SLICE = 1 << 21

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        both = []
        for base in (_BASE, _UNBASE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        if size > 4 * SLICE:  # for one huge document only
            return both[0], both[1]
        _powers[:] = both
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Bytes of several documents and the places of their words."""

    data: np.ndarray  # uint8
    offsets: np.ndarray  # of the documents in data, one more than there are documents
    starts: np.ndarray  # of words
    ends: np.ndarray
    doc: np.ndarray  # index of each word's document

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None, prefix: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of the words, or of other spans."""
        prefix = self.prefix() if prefix is None else prefix
        starts, ends = (self.starts, self.ends) if starts is None else (starts, ends)
        if not len(starts):
            return np.zeros(0, np.uint64)
        _, inverse = powers(len(self.data) + 1)
        return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))

    def prefix(self) -> np.ndarray:
        power, _ = powers(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * power[: len(self.data)], out=out[1:])
        return out


def parts(column: pa.Array | pa.ChunkedArray, lower: bool, most: int = SLICE) -> Iterator[tuple[int, int, Words]]:
    """(first document, last + 1, words) over a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        own = data[offsets[i] : offsets[j]]
        yield i, j, words(LOWER[own] if lower else own, offsets[i : j + 1] - offsets[i])
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = True
    before[1:] = ~word[:-1]
    before |= edge[:-1]
    starts = np.flatnonzero(word & before)
    after = np.empty(len(data), bool)
    after[-1:] = True
    after[:-1] = ~word[1:]
    after |= edge[1:]
    ends = np.flatnonzero(word & after) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(offsets, starts, "right") - 1)


def per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often mask holds within each document."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
