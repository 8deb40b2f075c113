"""Whole texts of an Arrow batch as one byte array, cut into words, lines and hashes with numpy.

A word is a run of bytes other than space and the five control characters 0x09 to 0x0D; UTF-8 keeps these bytes for
themselves, so cutting bytes equals cutting characters. Hashes are polynomials modulo 2**64 over fixed random byte
values, taken from prefix sums: any span of the text is hashed with two look-ups, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; a longer text is a piece of its own.
PIECE_BYTES = 512 << 10
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(20240117).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2**64; kept for later calls in the same worker."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= PIECE_BYTES * 2:
            _powers[base] = have
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Piece:
    """The texts of some consecutive rows. ``first`` and ``n`` say which rows of the batch."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, first: int, lower: bool = False):
        self.data = data + ((data - np.uint8(65)) < 26).view(np.uint8) * np.uint8(32) if lower else data
        self.starts, self.first, self.n = starts, first, len(starts) - 1
        self._sums = None

    def cuts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of every word, and the row (within the piece) that it is in."""
        ink = (self.data != 0x20) & ((self.data - np.uint8(0x09)) > 4)  # compared, as a look-up of every byte takes ten times as long
        size = len(ink)
        if not size:
            none = np.zeros(0, np.int64)
            return none, none, none
        begin = ink.copy()
        begin[1:] &= ~ink[:-1]
        stop = ink.copy()
        stop[:-1] &= ~ink[1:]
        edge = self.starts[1:-1]
        edge = edge[(edge > 0) & (edge < size)]
        begin[edge] = ink[edge]
        stop[edge - 1] = ink[edge - 1]
        s = np.flatnonzero(begin)
        return s, np.flatnonzero(stop) + 1, self.row_of(s)

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def hashes(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """A hash of each span of bytes."""
        if self._sums is None:
            p = powers(_BASE, len(self.data))
            sums = np.empty(len(self.data) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_BYTE_VALUE[self.data] * p[: len(self.data)], out=sums[1:])
            self._sums = sums
        return (self._sums[e] - self._sums[s]) * powers(_INVERSE, len(self.data))[s]

    def chars(self) -> np.ndarray:
        """Code points before each byte, one entry more than bytes."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out

    def per_row(self, flag: np.ndarray) -> np.ndarray:
        """How many bytes of each row are flagged."""
        out = np.zeros(len(flag) + 1, np.int64)
        np.cumsum(flag, out=out[1:])
        return out[self.starts[1:]] - out[self.starts[:-1]]


def ngrams(words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of all runs of n words inside one row, and the index of each run's first word."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = mixed(out * np.uint64(_BASE) + words[k : len(words) - n + 1 + k])
    at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
    return out[at], at


def pieces(column: pa.Array, lower: bool = False, size: int = PIECE_BYTES) -> Iterator[Piece]:
    """The column's texts in order; a null counts as an empty text."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield Piece(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first, lower)
        first = last
    pa.default_memory_pool().release_unused()  # workers live on between stages
