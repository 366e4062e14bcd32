"""Whole texts as byte arrays: words, word hashes and hashed n-gram counts of many documents at once, in numpy.

A block holds consecutive rows of an Arrow string column up to a number of bytes; a longer text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES, BLOCK_ROWS = 1 << 19, 1024  # small enough for caches, and for the memory that a worker keeps
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLIER = 0x9E3779B97F4A7C15


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    out[1:] = np.uint64(_MULTIPLIER)
    return np.multiply.accumulate(out)


@dataclass
class Block:
    lo: int  # rows of the column
    hi: int
    data: np.ndarray  # bytes of these rows
    offsets: np.ndarray  # of each row in data, and the end

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    @cached_property
    def _breaks(self) -> np.ndarray:
        first = np.zeros(len(self.data) + 1, bool)
        first[self.offsets] = True
        return first

    @cached_property
    def starts(self) -> np.ndarray:
        """The byte at which each word begins."""
        solid = ~WHITE[self.data]
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | self._breaks[1:-1]
        return np.flatnonzero(begin)

    @cached_property
    def ends(self) -> np.ndarray:
        solid = ~WHITE[self.data]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | self._breaks[1:-1]
        return np.flatnonzero(last) + 1

    @cached_property
    def word_rows(self) -> np.ndarray:
        """The row (within the block) of each word."""
        return np.searchsorted(self.offsets, self.starts, "right") - 1

    @cached_property
    def word_hashes(self) -> np.ndarray:
        """64-bit hashes of the words, A-Z in lower case."""
        if not len(self.starts):
            return np.empty(0, np.uint64)
        sizes = self.ends - self.starts
        first = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        chars = LOWER[self.data[np.repeat(self.starts, sizes) + at]]
        terms = _VALUES[chars] * powers(int(sizes.max()))[at]
        return mix64(np.add.reduceat(terms, first) + sizes.astype(np.uint64))

    def counts(self, codes: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(rows * width + codes, minlength=self.rows * width).reshape(self.rows, width)

    @cached_property
    def byte_rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.offsets))


def blocks(column: pa.Array, limit: int = BLOCK_BYTES, rows: int = BLOCK_ROWS) -> Iterator[Block]:
    """Blocks that together hold every row of a string or binary column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, min(lo + rows, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1))
        yield Block(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi
