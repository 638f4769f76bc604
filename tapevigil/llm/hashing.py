"""Words of many texts at once, and hashes of words and word sequences, as numpy arrays.

Sequence hashes are polynomials modulo 2^64 taken from running sums, so the hash
of any stretch costs two look-ups; all are mixed at the end.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of unsigned 64-bit integers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(base: int, log_size: int) -> np.ndarray:
    steps = np.full(1 << log_size, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, max(16, int(n).bit_length()))[:n]


class Stretches:
    """Hashes of stretches of a sequence of unsigned 64-bit values."""

    def __init__(self, values: np.ndarray, base: int):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(base, len(values)), out=self.sums[1:])
        self.inverse = powers(pow(base, -1, 1 << 64), len(values) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def grams(self, k: int) -> np.ndarray:
        """Mixed hash of each run of k values."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:-k]) * self.inverse[:n] + np.uint64(k))


class Words:
    """Words of a column of texts: `hash` of each, and `first`, each text's first word (and one past the last)."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, "")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        _, ends, data = column.buffers()
        wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
        at = np.frombuffer(ends, wide)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
        at = at - at[0]
        inside = ~SPACE[raw]
        before, after = np.roll(inside, 1), np.roll(inside, -1)
        inner = at[:-1][at[:-1] < len(raw)]
        before[inner] = False
        after[at[1:][at[1:] > 0] - 1] = False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(start, at)
        sums = Stretches(raw.astype(np.uint64) + np.uint64(1), BYTE_BASE).of(start, end)
        self.hash = mix(sums ^ ((end - start).astype(np.uint64) << np.uint64(40)))

    def stretches(self) -> Stretches:
        return Stretches(self.hash, WORD_BASE)


def least_of_runs(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values, the index of its leftmost smallest one."""
    best, at, size = values, np.arange(len(values)), 1

    def joined(shift: int):
        n = len(best) - shift
        left = best[:n] <= best[shift:]
        return np.where(left, best[:n], best[shift:]), np.where(left, at[:n], at[shift:])

    if len(values) < width:
        return np.zeros(0, np.int64)
    while size * 2 <= width:
        best, at = joined(size)
        size *= 2
    if size < width:
        best, at = joined(width - size)
    return at
