"""FM-index of word sequences: wavelet matrix, backward search, matching statistics, all in numpy."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in lexicographic order, and how many symbols each shares with the one before it.

    By prefix doubling: ranks by 1, 2, 4, ... symbols, until all differ; the same ranks then
    give the shared lengths, longest step first. ``symbols`` must end with one that occurs once.
    """
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    order, by_length, length = np.argsort(rank, kind="stable"), [], 1
    while rank.max(initial=0) < n - 1:
        by_length.append((length, rank.astype(np.int32)))
        after = np.zeros(n, np.int64)
        after[: max(n - length, 0)] = rank[length:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        step = np.zeros(n, np.int64)
        step[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        length *= 2
    shared = np.zeros(max(n - 1, 0), np.int64)
    for length, ranks in reversed(by_length):
        a, b = order[:-1] + shared, order[1:] + shared
        inside = np.maximum(a, b) < n
        shared += length * (inside & (ranks[np.minimum(a, n - 1)] == ranks[np.minimum(b, n - 1)]))
    return order, np.concatenate(([-1], shared)).astype(np.int32)


class Bits:
    """Bit vector of packed words with a running count for each, for rank in constant time."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate((packed, np.zeros(-len(packed) % 8 + 8, np.uint8)))
        self.words = packed.view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(ones)))[:-1].astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class FMIndex:
    """Burrows-Wheeler transform of ``symbols`` in a wavelet matrix, and the lengths that
    neighbouring suffixes share. Neither the symbols nor the order of the suffixes is kept:
    matching statistics need no places.

    Memory for ``n`` symbols of ``s`` kinds: ``n log2(s)`` bits and a half as many for their
    counts, and ``4 n log2(n)`` bytes of minima over shared lengths.
    """

    def __init__(self, symbols: np.ndarray):
        self.size = len(symbols)
        order, shared = suffix_order(symbols)
        values = symbols[order - 1].astype(np.int64)
        count = np.bincount(symbols)
        self.height = max(int(len(count) - 1).bit_length(), 1)
        self.levels: list[tuple[Bits, int]] = []
        for level in range(self.height - 1, -1, -1):
            bit = (values >> level) & 1
            self.levels.append((Bits(bit.astype(np.uint8)), int(len(bit) - bit.sum())))
            values = np.concatenate((values[bit == 0], values[bit == 1]))
        every = np.arange(len(count))
        first = np.cumsum(count) - count
        self.base = first - self._descend(every, np.zeros(len(count), np.int64))
        # Entry i of table k is the least of the 2^k shared lengths from i on; the ends close off.
        self.least = [np.concatenate((shared, np.array([-1], np.int32)))]
        while 2 ** len(self.least) <= self.size + 1:
            below, half = self.least[-1], 2 ** (len(self.least) - 1)
            self.least.append(np.minimum(below[:-half], below[half:]))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in zip(range(self.height - 1, -1, -1), self.levels):
            ones = bits.rank(i)
            i = np.where((symbol >> level) & 1, zeros + ones, i - ones)
        return i

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals after one more symbol in front of each pattern."""
        both = self._descend(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        base = self.base[symbol]
        return both[: len(symbol)] + base, both[len(symbol) :] + base

    def widen(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next larger suffix intervals around intervals, and the length they have in common."""
        depth = np.maximum(self.least[0][low], self.least[0][high])
        low, high = low.copy(), high.copy()
        for k in range(len(self.least) - 1, -1, -1):
            table = self.least[k]
            at = low - (1 << k) + 1
            low -= ((at >= 0) & (table[np.maximum(at, 0)] >= depth)).astype(np.int64) << k
            high += ((high < len(table)) & (table[np.minimum(high, len(table) - 1)] >= depth)).astype(np.int64) << k
        return low, high, depth

    def statistics(self, patterns: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Matching statistics: for every position how many symbols from there on, within its
        pattern, occur in the index together.

        Patterns are the ``sizes`` symbols before ``ends`` in ``patterns``; symbols the index
        does not have are -1. All patterns move one symbol to the left at a time; where that
        leaves no suffix, a pattern drops symbols at its right end until one is left.
        """
        found = np.zeros(len(patterns), np.int64)
        by_size = np.argsort(-sizes, kind="stable")
        ends, sizes = ends[by_size], sizes[by_size]
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        depth = np.zeros(len(ends), np.int64)
        for step in range(1, int(sizes.max(initial=0)) + 1):
            live = int(np.searchsorted(-sizes, -step, side="right"))
            at = ends[:live] - step
            symbol = patterns[at]
            strange = np.flatnonzero(symbol < 0)
            low[strange], high[strange], depth[strange] = 0, self.size, 0
            left = np.flatnonzero(symbol >= 0)
            while len(left):
                a, b = self.extend(symbol[left], low[left], high[left])
                hit = b > a
                done = left[hit]
                low[done], high[done] = a[hit], b[hit]
                depth[done] += 1
                left = left[~hit]
                if len(left):
                    low[left], high[left], depth[left] = self.widen(low[left], high[left])
            found[at] = depth[:live]
        return found
