"""FM-index of a shard of symbol sequences: suffix order, wavelet matrix ranks, backward search, sampled positions.

The shard is a list of sequences of symbols 0..sigma-1, each closed by a separator that no pattern holds. Every separator sorts
differently, so that no comparison of suffixes runs over the end of a sequence.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, n_low: int, width: int) -> np.ndarray:
    """Suffix array of text, whose values below n_low occur once each (the separators) and whose last value is one of them.

    Prefix doubling; after the first sort, only suffixes that are still tied are sorted again.
    """
    n = len(text)
    pack = max(1, 63 // max(width, 1))
    key = text.astype(np.int64)
    for k in range(1, pack):
        nxt = np.zeros(n, dtype=np.int64)
        nxt[: max(n - k, 0)] = text[k:]
        key = (key << width) | nxt
    # what follows a separator must not count, but separators differ: no tie reaches beyond one
    sa = np.argsort(key, kind="stable")
    held = key[sa]
    head = np.empty(n, dtype=bool)
    head[0], head[1:] = True, held[1:] != held[:-1]
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = group
    h = pack
    while True:
        tied = ~head
        tied[:-1] |= ~head[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            return sa
        own = sa[slots]
        key = group[slots] * n + rank[np.minimum(own + h, n - 1)]
        order = np.argsort(key, kind="stable")
        own, key = own[order], key[order]
        sa[slots] = own
        new = np.empty(len(slots), dtype=bool)
        new[0], new[1:] = True, key[1:] != key[:-1]
        head[slots] = new
        group[slots] = np.maximum.accumulate(np.where(new, slots, 0))
        rank[own] = group[slots]
        h *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence: one row of bits for each bit of a symbol, counted by words of 64."""

    def __init__(self, values: np.ndarray, width: int):
        self.width, self.zeros, self.bits, self.before = width, [], [], []
        values = values.astype(np.int64)
        n = len(values)
        for level in range(width - 1, -1, -1):
            bit = (values >> level) & 1
            padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
            padded[:n] = bit
            packed = np.packbits(padded, bitorder="little").view("<u8")
            counts = np.bitwise_count(packed).astype(np.int64)
            self.bits.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(counts)[:-1]]))
            ones = bit.astype(bool)
            self.zeros.append(n - int(bit.sum()))
            values = np.concatenate([values[~ones], values[ones]])

    def down(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where `places` of the sequence arrive after the sort by all bits of the given symbols."""
        p = places
        for row, level in enumerate(range(self.width - 1, -1, -1)):
            word, rest = p >> 6, (p & 63).astype(np.uint64)
            ones = self.before[row][word] + np.bitwise_count(self.bits[row][word] & ((np.uint64(1) << rest) - np.uint64(1))).astype(np.int64)
            p = np.where((symbols >> level) & 1, self.zeros[row] + ones, p - ones)
        return p


class FMIndex:
    """Backward search over the concatenated sequences; sample: each how many places a position is kept (0: none, no locate)."""

    def __init__(self, sequences: np.ndarray, lengths: np.ndarray, sigma: int, sample: int = 8):
        lengths = np.asarray(lengths, dtype=np.int64)
        n_seq = len(lengths)
        total = int(lengths.sum()) + n_seq
        ends = np.cumsum(lengths + 1) - 1
        text = np.empty(total, dtype=np.int64)
        is_end = np.zeros(total, dtype=bool)
        is_end[ends] = True
        text[is_end] = np.arange(n_seq)
        text[~is_end] = sequences + n_seq
        self.n, self.sigma, self.n_low = total, sigma, n_seq
        sa = suffix_order(text, n_seq, max(1, int(n_seq + sigma).bit_length()))
        folded = np.where(is_end, 0, text - n_seq + 1)  # separators are one symbol from here on
        bwt = folded[sa - 1]  # at sa == 0 this is the last separator
        self.width = max(1, int(sigma).bit_length())
        self.wavelet = WaveletMatrix(bwt, self.width)
        counts = np.bincount(folded, minlength=sigma + 2)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        every = np.arange(sigma + 1)
        self.base = self.wavelet.down(every, np.zeros(sigma + 1, dtype=np.int64))
        self.sa = sa
        if sample:
            starts = np.zeros(total, dtype=bool)
            starts[0] = True
            starts[ends[:-1] + 1] = True
            kept = starts | (np.arange(total) % sample == 0)
            at = kept[sa]
            self.sampled = np.where(at, np.cumsum(at) - 1, -1)
            self.positions = sa[at]
            self.bwt = bwt.astype(np.int32)

    def forget_order(self) -> None:
        """Drops the full suffix array; ranks and sampled positions stay."""
        self.sa = None

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the rows of `symbols` put before what [low, high) stands for. Symbols count from 1 here."""
        shift = self.first[symbols] - self.base[symbols]
        return shift + self.wavelet.down(symbols, low), shift + self.wavelet.down(symbols, high)

    def matches(self, text: np.ndarray, ends: np.ndarray, most: np.ndarray | int, rows: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics by backward search: how many symbols of text before each of `ends` (exclusive) occur together, at
        most `most`; and the rows [low, high) of that match. The caller sees to it that `most` stays inside text. Symbols from 0;
        one of -1 matches nothing. A match counts as long as it has `rows` rows at least: 2 for text that is itself in the index, so
        that the search ends where only the text's own place is left."""
        n = len(ends)
        most = np.broadcast_to(np.asarray(most, dtype=np.int64), (n,))
        low, high = np.zeros(n, dtype=np.int64), np.full(n, self.n, dtype=np.int64)
        length = np.zeros(n, dtype=np.int64)
        active = np.flatnonzero(most > 0)
        k = 0
        while len(active):
            symbols = text[ends[active] - 1 - k] + 1
            known = symbols > 0
            active, symbols = active[known], symbols[known]
            if k:  # equal matches with an equal symbol before them take one step together
                keys, each = np.unique(low[active] * (self.sigma + 2) + symbols, return_inverse=True)
                upper = np.empty(len(keys), dtype=np.int64)
                upper[each] = high[active]
                lo, hi = (x[each] for x in self.step(keys % (self.sigma + 2), keys // (self.sigma + 2), upper))
            else:
                lo, hi = self.first[symbols], self.first[symbols + 1]
            good = hi - lo >= rows
            active, lo, hi = active[good], lo[good], hi[good]
            low[active], high[active] = lo, hi
            length[active] += 1
            k += 1
            active = active[most[active] > k]
        return length, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: backward steps to the next sampled position."""
        out = np.empty(len(rows), dtype=np.int64)
        todo, at, walked = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            slot = self.sampled[at]
            done = slot >= 0
            out[todo[done]] = self.positions[slot[done]] + walked
            todo, at = todo[~done], at[~done]
            symbols = self.bwt[at].astype(np.int64)
            at = self.first[symbols] - self.base[symbols] + self.wavelet.down(symbols, at)
            walked += 1
        return out
