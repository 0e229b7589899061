"""Byte and word kernels in numpy over runs of whole texts.

A chunk holds whole documents, one space between them, so one pass of array
operations serves many short documents or a single long one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
WORDS = ~SPACES
#: 0 space, 1 letters, digits and all bytes beyond ASCII, 2 other characters.
CLASSES = np.where(SPACES, 0, 2).astype(np.uint8)
CLASSES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
ALNUM = CLASSES == 1
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _tables or len(_tables["up"]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.empty(size, np.uint64)
            table[0], done = 1, 1
            while done < size:
                more = min(done, size - done)
                table[done:done + more] = table[:more] * np.uint64(pow(base, done, 1 << 64))
                done += more
            _tables[name] = table
    return _tables["up"], _tables["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def texts(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null is empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


@dataclass
class Chunk:
    """Documents ``first`` to ``first + len(starts) - 1`` of a batch in one buffer."""
    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def rows(self) -> range:
        return range(self.first, self.first + len(self.starts))


def chunks(values: Sequence[bytes], lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a batch into chunks of about ``limit`` bytes; no document is divided."""
    first = 0
    while first < len(values):
        last, size = first, 0
        while last < len(values) and (last == first or size + len(values[last]) + 1 <= limit):
            size += len(values[last]) + 1
            last += 1
        part = values[first:last]
        joined = b" ".join(part) + b" "
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
        yield Chunk(first, np.frombuffer(joined.translate(LOWER) if lower else joined, np.uint8), starts, starts + lengths)
        first = last


class Hashes:
    """Hash of any byte range of a buffer in constant time."""

    def __init__(self, data: np.ndarray):
        up, self._down = _powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts])

    def windows(self, size: int) -> np.ndarray:
        """Hash of every range of ``size`` bytes, by start."""
        count = len(self._sums) - size
        return mix((self._sums[size:] - self._sums[:count]) * self._down[:count]) if count > 0 else np.zeros(0, np.uint64)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.diff(mask.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def owners(chunk: Chunk, starts: np.ndarray) -> np.ndarray:
    """The document (within the chunk) of each start."""
    return np.searchsorted(chunk.starts, starts, "right") - 1


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def words(chunk: Chunk, letters: np.ndarray = WORDS, hashes: Hashes | None = None) -> Words:
    """Maximal runs of the bytes in ``letters``, with their documents and hashes."""
    starts, ends = runs(letters[chunk.data])
    return Words(starts, ends, owners(chunk, starts), (hashes or Hashes(chunk.data)).of(starts, ends))


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``size`` words that lies within one document, and the index of its first word."""
    count = len(w.hash) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.flatnonzero(w.doc[:count] == w.doc[size - 1:])
    h = np.zeros(len(inside), np.uint64)
    for k in range(size):
        h = mix(h + w.hash[inside + k] * np.uint64(2 * k + 3))
    return h, inside


def per_doc(chunk: Chunk, doc: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Count, or sum of ``weights``, for each document of the chunk."""
    return np.bincount(doc, weights, minlength=len(chunk)).astype(np.int64)


def repeats(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How often each (document, hash) occurs, for every entry; and the first-seen flag packed in the second row."""
    order = np.lexsort((h, doc))
    d, s = doc[order], h[order]
    new = np.ones(len(order), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    group = np.cumsum(new) - 1
    out = np.empty((2, len(order)), np.int64)
    out[0, order] = np.bincount(group)[group] if len(order) else 0
    out[1, order] = new
    return out
