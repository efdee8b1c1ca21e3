"""An FM-index over a sequence of numbers, with a wavelet matrix for ranks and sampled suffix positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    key = text[order]
    fresh = np.append(True, key[1:] != key[:-1]) if n else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    width = 1
    # rows of the order that share their rank with a neighbour
    open_ = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    while len(open_):
        at = order[open_]
        behind = np.where(at + width < n, rank[np.minimum(at + width, n - 1)], -1)
        mine = rank[at]
        by = np.lexsort((behind, mine))
        at, behind, mine = at[by], behind[by], mine[by]
        order[open_] = at
        new_head = np.append(True, (mine[1:] != mine[:-1]) | (behind[1:] != behind[:-1]))
        place = np.maximum.accumulate(np.where(new_head, open_, 0))
        rank[at] = place
        alone = new_head & np.append(new_head[1:], True)
        open_ = open_[~alone]
        width *= 2
    return order


class Wavelet:
    """Ranks and values of a sequence: one packed bit row for each bit of the alphabet, zeros moved to the front."""

    def __init__(self, values: np.ndarray, bits: int):
        self.n, self.bits = len(values), bits
        self.rows, self.sums, self.zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            packed = np.zeros((len(bit) // 64 + 1) * 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view(np.uint64)
            count = np.bitwise_count(words).astype(np.int64)
            self.rows.append(words)
            self.sums.append(np.append(0, np.cumsum(count)[:-1]))
            self.zeros.append(len(bit) - int(count.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.sums[level][block] + np.bitwise_count(self.rows[level][block] & below).astype(np.int64)

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``value`` stands before ``at``."""
        start = np.zeros_like(at)
        for level in range(self.bits):
            one = ((value >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = self._ones(level, start), self._ones(level, at)
            start = np.where(one, self.zeros[level] + a, start - a)
            at = np.where(one, self.zeros[level] + b, at - b)
        return at - start

    def value(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for level in range(self.bits):
            one = ((self.rows[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            ones = self._ones(level, at)
            out = (out << 1) | one
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return out


class FMIndex:
    """``text`` holds numbers from 1 to ``top``; 0 is free for separators, which no phrase holds."""

    def __init__(self, text: np.ndarray, top: int):
        self.text_size = len(text)
        text = np.append(text, 0).astype(np.int64)
        order = suffix_array(text)
        self.bits = max(1, int(top).bit_length())
        last = text[order - 1]
        self.wavelet = Wavelet(last, self.bits)
        self.before = np.append(0, np.cumsum(np.bincount(text, minlength=top + 1)))
        # where a run of words begins the position is on file too, so steps back never cross a separator
        kept = (order % SAMPLE == 0) | (last == 0)
        self.sampled = Wavelet(kept.astype(np.int64), 1)
        self.positions = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row ranges of phrases of one length (a row each), read from their last word to their first."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.text_size + 1, np.int64)
        live = np.arange(len(phrases))
        for place in range(phrases.shape[1] - 1, -1, -1):
            word = phrases[live, place]
            low[live] = self.before[word] + self.wavelet.rank(word, low[live])
            high[live] = self.before[word] + self.wavelet.rank(word, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows begin: step back until a row has its position on file."""
        out = np.zeros(len(rows), np.int64)
        live, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(live):
            known = self.sampled.value(at) == 1
            hit = at[known]
            out[live[known]] = self.positions[self.sampled.rank(np.ones_like(hit), hit)] + steps
            live, at = live[~known], at[~known]
            word = self.wavelet.value(at)
            at = self.before[word] + self.wavelet.rank(word, at)
            steps += 1
        return out
