"""An FM-index of one shard: backward search through wavelet ranks, occurrences from sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in sorted order. ``s`` ends in 0, which stands nowhere else.

    As many symbols as fit are packed into one sort key; after that only suffixes that still tie are sorted again,
    by twice as many symbols each time.
    """
    n = len(s)
    bits = max(1, int(s.max()).bit_length())
    known = max(1, 62 // bits)
    key = np.zeros(n, dtype=np.int64)
    padded = np.concatenate([s, np.zeros(known, dtype=s.dtype)]).astype(np.int64)
    for j in range(known):
        key = (key << bits) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    place = np.arange(n)
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    head = np.maximum.accumulate(np.where(fresh, place, 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = head
    while True:
        alone = fresh & np.append(fresh[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            return order
        at, group = order[tied], head[tied]
        then = np.where(at + known < n, rank[np.minimum(at + known, n - 1)], -1)
        by = np.lexsort((then, group))
        at, group, then = at[by], group[by], then[by]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (then[1:] != then[:-1])
        order[tied], fresh[tied] = at, new
        head[tied] = np.maximum.accumulate(np.where(new, tied, 0))
        rank[at] = head[tied]
        known *= 2


class Wavelet:
    """Wavelet matrix over the transformed text: how often a symbol stands before a position, for many queries at once."""

    def __init__(self, s: np.ndarray) -> None:
        self.bits = max(1, int(s.max()).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for b in range(self.bits - 1, -1, -1):
            bit = (s >> b) & 1
            ones = np.zeros(len(s) + 1, dtype=np.int64)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(s) - int(ones[-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        start, end = np.zeros_like(end), end.copy()
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            up = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = ones[start], ones[end]
            start = np.where(up, zeros + a, start - a)
            end = np.where(up, zeros + b, end - b)
        return end - start


class FMIndex:
    """Of a sequence of symbols from 1 up; every ``every``-th text position keeps its place among the suffixes."""

    def __init__(self, s: np.ndarray, every: int = 8) -> None:
        s = np.append(s.astype(np.int64), 0)
        order = suffix_order(s)
        self.last = s[order - 1]
        self.wavelet = Wavelet(self.last)
        self.before = np.zeros(int(s.max()) + 2, dtype=np.int64)
        np.cumsum(np.bincount(s, minlength=int(s.max()) + 1), out=self.before[1:])
        self.marked = order % every == 0
        self.sample = np.where(self.marked, order, 0)[self.marked]
        self.nth = np.cumsum(self.marked) - 1

    def _step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.wavelet.rank(symbol, at)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffix order, first and end, that begin with each pattern (one a row, all equally long)."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), len(self.last), dtype=np.int64)
        live = np.flatnonzero((patterns < len(self.before) - 1).all(axis=1))
        dead = np.ones(len(patterns), dtype=bool)
        dead[live] = False
        high[dead] = 0
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j]
            low[live], high[live] = self._step(c, low[live]), self._step(c, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order, walking back to the next sampled one."""
        rows, steps, open_ = rows.copy(), np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        while len(open_ := open_[~self.marked[rows[open_]]]):
            rows[open_] = self._step(self.last[rows[open_]], rows[open_])
            steps[open_] += 1
        return self.sample[self.nth[rows]] + steps
