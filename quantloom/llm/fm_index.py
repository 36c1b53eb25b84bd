"""FM-index over integer words: wavelet-matrix ranks and sampled suffix positions.

The indexed text is a sequence of runs, each ended by the separator 0. Suffixes are
ordered up to their separator (equal ones by place), so backward search of a pattern
without separators is exact. Positions are sampled at every ``rate``-th place and at the
start of each run; a walk by last-to-first steps therefore meets a sample before it
would cross a separator.
"""

from __future__ import annotations

import numpy as np


class BitRank:
    """Bits with constant-time counts of ones before a place."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.ones = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletMatrix:
    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels: list[tuple[int, BitRank, int]] = []
        for shift in reversed(range(max(1, int(sigma).bit_length()))):
            bits = (seq >> shift) & 1
            br = BitRank(bits)
            zeros = len(seq) - br.ones
            self.levels.append((shift, br, zeros))
            seq = np.concatenate([seq[bits == 0], seq[bits == 1]])

    def place(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i of the sequence goes if followed as symbol c; differences are ranks."""
        for shift, br, zeros in self.levels:
            ones = br.rank(i)
            i = np.where((c >> shift) & 1, zeros + ones, i - ones)
        return i

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at i, and ``place`` of i for them."""
        c = np.zeros_like(i)
        for shift, br, zeros in self.levels:
            bit, ones = br.get(i), br.rank(i)
            c |= bit << shift
            i = np.where(bit, zeros + ones, i - ones)
        return c, i


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; separators (0) compare by place, so the text must end with one.

    A rank is the number of smaller suffixes as far as they are told apart; each round
    sorts only suffixes that still share theirs.
    """
    n = len(text)
    sep = text == 0
    first = np.where(sep, np.cumsum(sep) - 1, text.astype(np.int64) + int(sep.sum()))
    _, inverse, count = np.unique(first, return_inverse=True, return_counts=True)
    rank, open_ = (np.cumsum(count) - count)[inverse], np.flatnonzero(count[inverse] > 1)
    k = 1
    while len(open_):
        key = rank[open_] * n + rank[open_ + k]  # inside the text: the suffixes differ before the last separator's end
        key, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        at, group = np.cumsum(count) - count, key // n
        head = np.concatenate([[True], group[1:] != group[:-1]])
        new = group + at - at[head][np.cumsum(head) - 1]
        rank[open_] = new[inverse]
        open_, k = open_[count[inverse] > 1], 2 * k
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


class FmIndex:
    """``text`` holds words 1..sigma and separators 0, and ends with a separator."""

    def __init__(self, text: np.ndarray, sigma: int, rate: int = 8):
        sa = suffix_array(text)
        self.n = len(text)
        bwt = text[sa - 1].astype(np.int64)  # the first suffix is preceded by the closing separator
        self.wm = WaveletMatrix(bwt, sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        symbols = np.arange(sigma + 1, dtype=np.int64)
        self.start = self.wm.place(symbols, np.zeros(sigma + 1, np.int64))
        sampled = (sa % rate == 0) | (bwt == 0)
        self.mark, self.samples = BitRank(sampled.astype(np.uint8)), sa[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of equally long patterns, one a row."""
        m, length = patterns.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        for j in range(length - 1, -1, -1):
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            c = patterns[live, j]
            base = self.first[c] - self.start[c]
            lo[live], hi[live] = base + self.wm.place(c, lo[live]), base + self.wm.place(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        rows = rows.copy()
        out, steps, todo = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(todo):
            at = rows[todo]
            hit = self.mark.get(at) == 1
            done = todo[hit]
            out[done] = self.samples[self.mark.rank(at[hit])] + steps
            todo, at = todo[~hit], at[~hit]
            c, place = self.wm.access(at)
            rows[todo] = self.first[c] + place - self.start[c]
            steps += 1
        return out
