"""A word-level FM-index: suffix order, Burrows-Wheeler transform and a wavelet tree, all in NumPy arrays.

Symbols are 1..sigma; 0 ends each indexed sequence. Suffixes are ordered by their
first ``DEPTH`` symbols, which is all that a backward search for patterns up to
that length looks at. The wavelet tree keeps its levels side by side (the matrix
layout): one bit a symbol and level, with a running count every 64 bits. Searches
step for all patterns at once.
"""

from __future__ import annotations

import numpy as np

DEPTH = 16


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions ordered by the DEPTH symbols from there on, or more: each round joins as many ranks as fit 62 bits."""
    rank, depth = text.astype(np.int64), 1
    while True:
        bits = max(1, int(rank.max()).bit_length())
        joined = min(62 // bits, -(-DEPTH // depth))
        key = rank.copy()
        for k in range(1, joined):
            key <<= bits
            key[: -k * depth or None] |= rank[k * depth :]
        depth *= joined
        if depth >= DEPTH:
            return np.argsort(key, kind="stable")
        _, rank = np.unique(key, return_inverse=True)


#: The bits below each of 64 places.
_LOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Bits:
    """Bits packed in 64s with the count of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + bytes(16 - len(packed) % 8), np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]].astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & _LOW[at & 63])


class WaveletTree:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels, self.zeros = [], []
        for bit in range(max(1, int(sigma).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(ones)))
            self.zeros.append(int((~ones).sum()))
            symbols = np.r_[symbols[~ones], symbols[ones]]
        every = np.arange(sigma + 1, dtype=np.int32)
        self.first = self._descend(every, np.zeros_like(every))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for (bit, bits), zeros in zip(self.levels, self.zeros):
            ones = bits.ones(at)
            at = np.where(symbol & (1 << bit), ones + np.int32(zeros), at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the position beside it."""
        return self._descend(symbol, at) - self.first[symbol]


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int):
        self.order = suffix_order(text)
        self.tree = WaveletTree(text[self.order - 1], sigma)
        self.below = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma + 1))[:-1]].astype(np.int32)
        self.size = len(text)

    def matching(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of each row: how many of its last symbols match, and the interval of suffixes for a whole match."""
        last, *rest = np.ascontiguousarray(patterns.T[::-1].astype(np.int32))
        low, high = self.below[last], np.r_[self.below[1:], np.int32(self.size)][last]
        matched = (high > low).astype(np.int64)
        for column in rest:
            low = self.below[column] + self.tree.rank(column, low)
            high = self.below[column] + self.tree.rank(column, high)
            matched += high > low
        return matched, low, high


def interval_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low:high] for intervals that are equal or disjoint, none empty."""
    _, first, back = np.unique(low, return_index=True, return_inverse=True)
    edges = np.stack([low[first], high[first]], axis=1).ravel()
    return np.minimum.reduceat(np.r_[values, values[-1:]], edges)[::2][back]
