"""Suffix order, Burrows-Wheeler transform and wavelet-tree ranks over integer symbols, in numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(keys: np.ndarray, width: int = 1) -> np.ndarray:
    """Order of all suffixes, where ``keys[i]`` orders them by their first ``width`` symbols.

    Ranks double the length they look at; only suffixes not yet alone in their rank are sorted again.
    """
    n = len(keys)
    order = np.argsort(keys)
    fresh = np.empty(n, bool)
    fresh[:1] = True
    fresh[1:] = keys[order[1:]] != keys[order[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1  # the end sorts first
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    alone = fresh & np.append(fresh[1:], True)
    open_ = order[~alone]
    while len(open_):
        after = rank[np.minimum(open_ + width, n)] + 1
        key = rank[open_] * (n + 2) + after
        by = np.argsort(key)
        open_, key = open_[by], key[by]
        at = np.arange(len(open_))
        class_ = rank[open_]
        new_class = np.append(True, class_[1:] != class_[:-1])
        fresh = np.append(True, key[1:] != key[:-1])
        rank[open_] = class_ + np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(new_class, at, 0))
        open_ = open_[~(fresh & np.append(fresh[1:], True))]
        width *= 2
    out = np.empty(n, np.int64)
    out[rank[:n]] = np.arange(n)
    return out


class WaveletTree:
    """Counts a symbol before a place, one bit of the symbol per level."""

    def __init__(self, symbols: np.ndarray):
        self.bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for bit in range(self.bits - 1, -1, -1):
            set_ = (symbols >> bit & 1).astype(bool)
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(set_, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([symbols[~set_], symbols[set_]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        start, place = np.zeros_like(place), place.copy()
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            set_ = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            start = np.where(set_, zeros + ones[start], start - ones[start])
            place = np.where(set_, zeros + ones[place], place - ones[place])
        return place - start


class FMIndex:
    """Backward search and sampled locations over a sequence of symbols from 0 on."""

    SAMPLED = 32

    def __init__(self, symbols: np.ndarray):
        symbols = np.append(symbols.astype(np.int64) + 1, 0)  # an end that is unlike all symbols
        n = len(symbols)
        order = suffix_array(symbols)
        self.bwt = symbols[order - 1]
        self.tree = WaveletTree(self.bwt)
        self.before = np.append(0, np.cumsum(np.bincount(symbols, minlength=1)))
        sampled = order % self.SAMPLED == 0
        self.sampled = sampled
        self.samples_before = np.append(0, np.cumsum(sampled))
        self.samples = order[sampled]
        self.size = n

    def step(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.tree.rank(symbol, place)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank interval [low, high) of each row of ``phrases`` ."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        live = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, column] + 1
            known = symbol < len(self.before) - 1
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            low[live], high[live] = self.step(symbol, low[live]), self.step(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, ranks: np.ndarray) -> np.ndarray:
        """Places in the sequence of the given ranks: step back until one that is sampled."""
        out = np.zeros(len(ranks), np.int64)
        at, waiting, steps = ranks.copy(), np.arange(len(ranks)), 0
        while len(waiting):
            hit = self.sampled[at[waiting]]
            done = waiting[hit]
            out[done] = self.samples[self.samples_before[at[done]]] + steps
            waiting = waiting[~hit]
            at[waiting] = self.step(self.bwt[at[waiting]], at[waiting])
            steps += 1
        return out
