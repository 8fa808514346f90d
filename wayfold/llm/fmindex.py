"""A full-text index over short records of integer symbols, searched backwards in batches.

The text is the records one after another, each closed by the symbol 0. Of its Burrows-Wheeler transform only the
positions of each symbol are stored, sorted by symbol and then by position; the rank of a symbol is a binary search in
the positions of that symbol, which suits large alphabets. Symbols are numbered densely, so that counts per symbol
replace the sorted text, and positions and records take four bytes each: eight bytes a symbol. All operations work on
whole arrays.
"""

from __future__ import annotations

import numpy as np


class FMIndex:
    def __init__(self, records: np.ndarray):
        """records: an array of n rows of equally many symbols, all of them at least 1."""
        n, length = records.shape
        self.width = length + 1
        self.size = n * self.width
        if self.size >= 1 << 32:
            raise ValueError("a shard holds fewer than 2^32 symbols")
        self.alphabet, dense = np.unique(records, return_inverse=True)
        text = np.zeros((n, self.width), np.int32)
        text[:, :length] = dense.reshape(n, length) + 1
        suffixes = _suffix_array(text)
        before = np.roll(text.ravel(), 1)[suffixes]
        if n:
            before[suffixes % self.width == 0] = 0
        order = np.argsort(before, kind="stable")
        closers = int((before == 0).sum())
        #: Where each symbol stands in the transform, by symbol and position; `start` tells the slices of the symbols.
        self.positions = order[closers:].astype(np.uint32)
        counts = np.bincount(text.ravel(), minlength=len(self.alphabet) + 1)
        self.start = np.concatenate(([0], np.cumsum(counts[1:])))
        #: The first suffix that begins with each symbol: after the closers, one for each record.
        self.first = self.start[:-1] + n
        self.record = (suffixes // self.width).astype(np.uint32)

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals after one more symbol in front; empty ones have low == high."""
        at = np.searchsorted(self.alphabet, symbol)
        known = at < len(self.alphabet)
        known[known] = self.alphabet[at[known]] == symbol[known]
        at = np.where(known, at, 0)
        if not len(self.alphabet):
            return np.zeros_like(low), np.zeros_like(low)
        begin, end = self.start[at], self.start[at + 1]
        lo, hi = (self.first[at] + self._rank(begin, end, bound) for bound in (low, high))
        return np.where(known, lo, 0), np.where(known, hi, 0)

    def _rank(self, begin: np.ndarray, end: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many positions of a slice lie below a bound: a binary search in all slices at once."""
        lo, hi = begin.copy(), end.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            middle = (lo[open_] + hi[open_]) // 2
            below = self.positions[middle] < bound[open_]
            lo[open_[below]] = middle[below] + 1
            hi[open_[~below]] = middle[~below]
        return lo - begin

    def intervals(self, patterns: np.ndarray):
        """Backward search: for each length from 1, the rows of patterns whose suffix of that length occurs, with its interval.

        Stops when none is left. The records of an interval that are not in the next one match no further.
        """
        n, length = patterns.shape
        alive, low, high = np.arange(n), np.zeros(n, np.int64), np.full(n, self.size, np.int64)
        for j in range(length - 1, -1, -1):
            low, high = self.step(patterns[alive, j], low, high)
            on = low < high
            alive, low, high = alive[on], low[on], high[on]
            if not len(alive):
                return
            yield alive, low, high

    def search(self, patterns: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of patterns: the length of its longest suffix found in a record, and the interval of that suffix.

        A suffix shorter than `least` counts as length 0 with an empty interval.
        """
        n = len(patterns)
        matched, low, high = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for length, (alive, lo, hi) in enumerate(self.intervals(patterns), 1):
            if length >= least:
                matched[alive], low[alive], high[alive] = length, lo, hi
        return matched, low, high


def _suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorts the suffixes up to their record's closing symbol, by doubling; equal ones keep their order in the text."""
    n, width = text.shape
    rank = text.astype(np.int64)
    step = 1
    while step < width:
        later = np.zeros_like(rank)
        later[:, : width - step] = rank[:, step:]
        rank = np.unique(rank * (rank.max(initial=0) + 1) + later, return_inverse=True)[1].reshape(n, width).astype(np.int64)
        step *= 2
    return np.argsort(rank.ravel(), kind="stable")


def expand(low: np.ndarray, high: np.ndarray, at_most: int = 2_000_000):
    """Pairs (row, position) for all positions of all intervals, in blocks that hold about `at_most` of them."""
    count = high - low
    ends = np.cumsum(count)
    begin = 0
    while begin < len(count):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + at_most, side="right")))
        if count[begin] > at_most:
            for a in range(int(low[begin]), int(high[begin]), at_most):
                at = np.arange(a, min(a + at_most, int(high[begin])))
                yield np.full(len(at), begin), at
            begin += 1
            continue
        c = count[begin:end]
        row = np.repeat(np.arange(begin, end), c)
        at = np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[begin:end], c)
        yield row, at
        begin = end
