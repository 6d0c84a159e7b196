"""Words and word n-grams of whole batches of texts, in numpy.

A word is a run of bytes outside space, tab, LF, VT, FF and CR. Hashes are 64-bit polynomial hashes over
a random byte table, finished by an avalanche step; they are the same in every process and run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _GRAM = 0x9E3779B97F4A7C15, U(0xD1342543DE82EF95)
IS_WORD = np.ones(256, bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_rng = np.random.RandomState(20240229)
BYTE_HASH = _rng.randint(0, 2**32, 256).astype(U) << U(32) | _rng.randint(0, 2**32, 256).astype(U)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            grown = np.full(max(n + 1, 1 << 16), base, U)
            grown[0] = 1
            _powers[k] = np.multiply.accumulate(grown)
    return _powers[0], _powers[1]


class Words:
    """Word positions of the texts of one slice.

    ``data`` holds the bytes of all texts, ``first[r]`` the number of the first word of row r (one more entry at the end).
    """

    def __init__(self, column: pa.Array):
        column = column.fill_null("") if pa.types.is_string(column.type) else column.cast(pa.string()).fill_null("")
        self.rows = len(column)
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + self.rows + 1].astype(np.int64) if self.rows else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = raw[off[0] : off[-1]]
        self.offsets = off - off[0]
        n = len(self.data)
        word = np.zeros(n + 2, bool)
        word[1:-1] = IS_WORD[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        here = word[1:-1]
        self.starts = np.flatnonzero(here & (~word[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(here & (~word[2:] | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word."""
        n = len(self.data)
        if not len(self.starts):
            return np.zeros(0, U)
        power, inverse = _power(n + 1)
        q = np.zeros(n + 1, U)
        np.cumsum(BYTE_HASH[self.data] * power[:n], out=q[1:])
        return mix((q[self.ends] - q[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(U))

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash for each run of n words, by its first word; and which of those lie in one text."""
        m = len(hashes) - n + 1
        if m <= 0:
            return np.zeros(0, U), np.zeros(0, bool)
        g = hashes[:m].copy()
        for j in range(1, n):
            g *= _GRAM
            g += hashes[j : j + m]
        return mix(g), self.row[:m] == self.row[n - 1 :]
