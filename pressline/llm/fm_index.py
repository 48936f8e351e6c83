"""An FM-index over an array of symbols: suffix order, wavelet matrix of the BWT, sampled positions.

All queries are arrays: many phrases are searched, and many rows located, in the same numpy steps.
"""

from __future__ import annotations

import numpy as np

WORD = 64
# Rows located at a time; bounds the memory frequent phrases take.
STEP = 1 << 18


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in order. The last symbol must be the only smallest one.

    The first sort looks at as many symbols as fit in 62 bits; suffixes that still tie are ordered by doubling, and only
    those are sorted again.
    """
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length())
    depth = max(1, min(62 // bits, n))
    key = np.zeros(n, np.int64)
    for j in range(depth):
        key <<= bits
        key[: n - j] |= symbols[j:]
    order = np.argsort(key)
    ties, slots, group = order, np.arange(n), key[order]
    rank = np.zeros(n + 1, np.int64)
    while len(ties):
        new = np.ones(len(ties), bool)
        new[1:] = group[1:] != group[:-1]
        rank[ties] = np.maximum.accumulate(np.where(new, slots, 0))
        alone = new & np.append(new[1:], True)
        ties, slots = ties[~alone], slots[~alone]
        group = rank[ties] * (n + 1) + rank[np.minimum(ties + depth, n)]
        again = np.argsort(group)
        ties, group = ties[again], group[again]
        order[slots] = ties
        depth *= 2
    return order


class WaveletMatrix:
    """Rank and access on an array of symbols, with one bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.bits = max(1, (n_symbols - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            padded = np.zeros((len(bit) // WORD + 1) * WORD, np.uint8)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            ones = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=ones[1:])
            self.words.append(words)
            self.before.append(ones)
            self.zeros.append(len(bit) - int(ones[-1]))
            one = bit.astype(bool)
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & below)

    def path(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where ``at`` ends after following each symbol down; rank is the difference to the path from 0."""
        for level in range(self.bits):
            one = ((symbols >> (self.bits - 1 - level)) & 1).astype(bool)
            ones = self._ones(level, at)
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return at

    def symbol_and_path(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at ``at``, and where their paths end."""
        found = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            bit = (self.words[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            ones = self._ones(level, at)
            at = np.where(bit.astype(bool), self.zeros[level] + ones, at - ones)
            found = (found << 1) | bit.astype(np.int64)
        return found, at


class FmIndex:
    def __init__(self, symbols: np.ndarray, n_symbols: int, sample: int = 16):
        """``symbols``: values from 1 on, below ``n_symbols``; 0 is added as the end."""
        text = np.append(symbols.astype(np.int64), 0)
        order = suffix_order(text)
        self.n = len(text)
        self.tree = WaveletMatrix(text[order - 1], n_symbols)
        every = np.arange(n_symbols)
        starts = np.zeros(n_symbols + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=n_symbols), out=starts[1:])
        # Row of a symbol's first suffix, less where its path starts: added to a path's end it gives the row before.
        self.shift = starts[:-1] - self.tree.path(every, np.zeros(n_symbols, np.int64))
        self.marked = WaveletMatrix((order % sample == 0).astype(np.int64), 2)
        self.samples = order[order % sample == 0]

    def search(self, step_symbols, n_phrases: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases by backward search.

        ``step_symbols(phrases, j)`` gives the ``j``-th symbol from the end of these phrases.
        """
        low, high = np.zeros(n_phrases, np.int64), np.full(n_phrases, self.n)
        for j in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > j) & (low < high))
            symbols = step_symbols(live, j)
            low[live] = self.shift[symbols] + self.tree.path(symbols, low[live])
            high[live] = self.shift[symbols] + self.tree.path(symbols, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back until a row whose position is kept."""
        found = np.empty(len(rows), np.int64)
        open_, at, steps = np.arange(len(rows)), rows, 0
        while len(open_):
            kept = (self.marked.words[0][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            found[open_[kept]] = self.samples[self.marked._ones(0, at[kept])] + steps
            open_, at = open_[~kept], at[~kept]
            symbols, ends = self.tree.symbol_and_path(at)
            at, steps = self.shift[symbols] + ends, steps + 1
        return found

    def occurrences(self, low: np.ndarray, high: np.ndarray):
        """Yields ``(phrase, position)`` arrays for all rows of the ranges, a bounded number at a time."""
        sizes = np.maximum(high - low, 0)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        for start in range(0, total, STEP):
            number = np.arange(start, min(start + STEP, total))
            phrase = np.searchsorted(ends, number, side="right")
            yield phrase, self.locate(low[phrase] + number - (ends[phrase] - sizes[phrase]))
