"""An FM-index over a sequence of small integers: wavelet-matrix ranks, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling: only suffixes that still tie are sorted again."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    rank = np.empty(n, np.int64)
    heads = np.flatnonzero(np.append(True, seq[order][1:] != seq[order][:-1]))
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    step = 1
    while True:
        # groups of equal rank are runs of ``order`` that begin at the rank itself
        at = rank[order]
        tied = np.append(at[1:] == at[:-1], False)
        tied[1:] |= at[1:] == at[:-1]
        places = np.flatnonzero(tied)
        if not len(places):
            return order
        part, group = order[places], at[places]
        after = np.where(part + step < n, rank[np.minimum(part + step, n - 1)], -1)
        inner = np.lexsort((after, group))
        part, group, after = part[inner], group[inner], after[inner]
        order[places] = part
        fresh = np.append(True, (group[1:] != group[:-1]) | (after[1:] != after[:-1]))
        heads = np.flatnonzero(fresh)
        rank[part] = np.repeat(places[heads], np.diff(np.append(heads, len(places))))
        step *= 2


class FmIndex:
    """Index of ``seq`` (values 1 .. top); a 0 is added as the end."""

    def __init__(self, seq: np.ndarray, top: int):
        seq = np.append(seq, 0).astype(np.int64)
        order = suffix_order(seq)
        last = seq[order - 1]
        self.size = len(seq)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=top + 1))])
        self.bits = max(1, int(top).bit_length())
        self.ones: list[np.ndarray] = []  # per level: ones before each place
        self.zeros: list[int] = []
        rest = last
        for level in range(self.bits - 1, -1, -1):
            bit = (rest >> level) & 1
            ones = np.zeros(self.size + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.size - int(ones[-1]))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])
        kept = order % SAMPLE == 0
        self.kept_before = np.zeros(self.size + 1, np.int32)
        np.cumsum(kept, out=self.kept_before[1:])
        self.positions = order[kept]
        self.kept = kept

    def _rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first ``places`` of the transform."""
        start = np.zeros_like(places)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbols >> (self.bits - 1 - level)) & 1
            high, low = ones[places], ones[start]
            places = np.where(bit == 1, zeros + high, places - high)
            start = np.where(bit == 1, zeros + low, start - low)
        return places - start

    def _symbol_and_rank(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbols, start = np.zeros_like(places), np.zeros_like(places)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            high, low = ones[places].astype(np.int64), ones[start].astype(np.int64)
            bit = ones[places + 1] - high
            symbols = symbols * 2 + bit
            places = np.where(bit == 1, zeros + high, places - high)
            start = np.where(bit == 1, zeros + low, start - low)
        return symbols, places - start

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [lo, hi) of the suffixes that begin with each phrase, by backward search over all at once."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for step in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= step) & (lo < hi))
            if not len(live):
                break
            symbols = phrases[live, lengths[live] - step]
            lo[live] = self.before[symbols] + self._rank(symbols, lo[live])
            hi[live] = self.before[symbols] + self._rank(symbols, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps backwards to the nearest sampled position."""
        found = np.zeros(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            here = self.kept[at]
            found[todo[here]] = self.positions[self.kept_before[at[here]]] + steps
            todo, at = todo[~here], at[~here]
            if len(todo):
                symbols, rank = self._symbol_and_rank(at)
                at = self.before[symbols] + rank
            steps += 1
        return found
