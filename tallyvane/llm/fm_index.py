"""FM-index over integer symbols, with all searches of a block side by side in numpy.

The Burrows-Wheeler transform of a shard's text sits in a wavelet matrix of packed bits: one bit vector per binary digit
of the symbols, with a running count for every 64 bits. A backward search narrows the rows of many patterns at once, one
symbol per step; a located row walks back to the next sampled suffix position.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank of symbols in prefixes of a sequence."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        row = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = ((row >> level) & 1).astype(bool)
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, bool)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view("<u8").astype(np.uint64)
            counts = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.before.append(np.cumsum(counts) - counts)
            self.zeros.append(int(len(bit) - counts.sum()))
            row = np.concatenate([row[~bit], row[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & low)

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before position low, and before high."""
        start = np.zeros(len(symbol), np.int64)
        for level in range(self.bits):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b, c = (self._ones(level, x) for x in (start, low, high))
            start = np.where(one, self.zeros[level] + a, start - a)
            low = np.where(one, self.zeros[level] + b, low - b)
            high = np.where(one, self.zeros[level] + c, high - c)
        return low - start, high - start

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at each position, and how often it stands before."""
        symbol = np.zeros(len(at), np.int64)
        start = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            one = (self.words[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            symbol = symbol * 2 + one
            a, b = self._ones(level, start), self._ones(level, at)
            start = np.where(one, self.zeros[level] + a, start - a)
            at = np.where(one, self.zeros[level] + b, at - b)
        return symbol, at - start


def suffix_order(symbols: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Positions in the order of their suffixes, or of the first `depth` symbols of these; shorter ones come first."""
    n = len(symbols)
    rank, width = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1, 1
    while True:
        if depth is not None and width >= depth:
            return np.argsort(rank, kind="stable")
        key = rank * (n + 1)
        key[: n - width] += rank[width:]
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[1], (key[1:] != key[:-1]).astype(np.int64)])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        width *= 2
        if int(rank.max()) == n or width >= n:
            return np.argsort(rank, kind="stable") if depth is not None else order


class FMIndex:
    """Index of a text of symbols from 1 to size - 1; 0 separates and is never searched for.

    depth: patterns are no longer than this many symbols, and rows are then ordered by no more. Without it the order is
    that of whole suffixes and rows can be located.
    """

    def __init__(self, symbols: np.ndarray, size: int, depth: int | None = None, sample: int = 8):
        # One symbol less than all others ends the text, so that walking back passes from row to row without a break.
        symbols, size = np.append(symbols.astype(np.int64) + 1, 0), size + 1
        n = len(symbols)
        self.order = suffix_order(symbols, None if depth is None else depth + 1)
        last = symbols[self.order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])
        self.tree = WaveletMatrix(last, size)
        self.n = n
        self.sample = sample
        if depth is None:
            marked = self.order % sample == 0
            self.marked = marked
            self.number = np.cumsum(marked) - marked
            self.samples = self.order[marked]
            del self.order

    def search(self, patterns: np.ndarray, lengths: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each pattern: its symbols stand at the right end of a row of `patterns`. Those with fewer
        than `least` rows on the way are given up, with high <= low."""
        m = patterns.shape[1]
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.flatnonzero(lengths > 0)
        for step in range(m):
            live = live[lengths[live] > step]
            symbol = patterns[live, m - 1 - step] + 1
            if step == 0:
                a, b = self.first[symbol], self.first[symbol + 1]
            else:
                a, b = self.tree.rank(symbol, low[live], high[live])
                a, b = a + self.first[symbol], b + self.first[symbol]
            good = (b - a >= least) & (symbol > 1)
            low[live], high[live] = a, np.where(good, b, a)
            live = live[good]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position of each row's suffix in the text."""
        out = np.full(len(rows), -1, np.int64)
        at, open_, steps = rows.copy(), np.arange(len(rows)), 0
        while len(open_):
            there = self.marked[at]
            out[open_[there]] = self.samples[self.number[at[there]]] + steps
            at, open_ = at[~there], open_[~there]
            if not len(open_):
                break
            symbol, before = self.tree.get(at)
            at = self.first[symbol] + before
            steps += 1
        return out
