"""Suffix order of texts from their prefix-free parse.

Texts are sequences of phrases that overlap by ``w`` bytes, the trigger between them. The
*dictionary* holds the distinct phrases and ranks all their suffixes (prefix doubling;
equal suffixes have equal ranks). The *parse* is the sequence of phrase ranks with a
separator after each text, and has a suffix array of its own. A text's suffix that starts
in a phrase is then ordered by the rank of the phrase's suffix and, among equal ones, by
the place of the next phrase in the suffix array of the parse; the bytes that two
neighbours share follow from the parse as well. This is the order of all suffixes of the
texts where no phrase suffix longer than ``w`` is a proper prefix of another one, which
holds where every phrase but a text's last ends at the first trigger after its start.
"""

from __future__ import annotations

import numpy as np

from .fm_index import suffix_array

#: Shared bytes are counted up to here.
CAP = 64


class Dictionary:
    """Distinct phrases in byte order, and the ranks of all their suffixes."""

    def __init__(self, phrases: set[bytes]):
        self.phrases = sorted(phrases)
        self.rank_of = {p: i for i, p in enumerate(self.phrases)}
        self.size = np.fromiter(map(len, self.phrases), np.int64, len(self.phrases))
        self.begin = np.cumsum(self.size) - self.size
        self.buf = np.frombuffer(b"".join(self.phrases), np.uint8)
        self.suffix = self._ranks()

    def _ranks(self) -> np.ndarray:
        n = len(self.buf)
        left = np.repeat(self.begin + self.size, self.size) - np.arange(n)
        key = np.zeros(n, np.uint64)
        for j in range(7):
            key <<= np.uint64(8)
            here = left[: max(0, n - j)] > j
            key[: len(here)][here] |= self.buf[j:][here].astype(np.uint64)
        key = key << np.uint64(8) | np.minimum(left, 7).astype(np.uint64)
        rank, k = np.unique(key, return_inverse=True)[1].astype(np.int64), 7
        while k < left.max(initial=0):
            after = np.zeros(n, np.int64)
            far = np.flatnonzero(left > k)
            after[far] = rank[far + k] + 1
            rank, k = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64), 2 * k
        return rank

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes (up to CAP) that phrases a and b have in common at their start."""
        wide = np.zeros((len(self.phrases), CAP), np.uint8)
        row = np.repeat(np.arange(len(self.size)), np.minimum(self.size, CAP))
        col = np.arange(len(row)) - np.repeat(np.cumsum(np.minimum(self.size, CAP)) - np.minimum(self.size, CAP), np.minimum(self.size, CAP))
        wide[row, col] = self.buf[self.begin[row] + col]
        out = np.empty(len(a), np.int64)
        for lo in range(0, len(a), 1 << 16):
            x, y = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)]
            differ = wide[x] != wide[y]
            first = np.where(differ.any(1), differ.argmax(1), CAP)
            out[lo : lo + len(x)] = np.minimum(first, np.minimum(self.size[x], self.size[y]))
        return out


class Parse:
    """``sequence``: phrase ranks plus one, and 0 after each text; texts must not be empty."""

    def __init__(self, dictionary: Dictionary, sequence: np.ndarray, w: int):
        self.d, self.sequence, self.w = dictionary, sequence, w
        self.order = suffix_array(sequence)
        self.rank = np.empty(len(sequence), np.int64)
        self.rank[self.order] = np.arange(len(sequence))
        self._low = self._minima(self._neighbours())

    def _neighbours(self) -> np.ndarray:
        """Bytes that a parse suffix shares with the one before it in order, up to CAP."""
        seq, d = self.sequence, self.d
        out = np.zeros(len(seq), np.int64)
        at = np.arange(1, len(seq))
        i, j = self.order[:-1].copy(), self.order[1:].copy()
        open_ = np.zeros(len(seq), bool)  # the phrase before matched, its trigger is yet to be counted
        while len(at):
            p, q = seq[i], seq[j]
            ended = (p == 0) | (q == 0)
            out[at[ended & open_[at]]] += self.w
            same = ~ended & (p == q)
            differ = ~ended & ~same
            out[at[differ]] += d.shared(p[differ] - 1, q[differ] - 1)
            out[at[same]] += d.size[p[same] - 1] - self.w
            open_[at[same]] = True
            go = same & (out[at] < CAP)
            at, i, j = at[go], i[go] + 1, j[go] + 1
        return np.minimum(out, CAP)

    @staticmethod
    def _minima(x: np.ndarray) -> list[np.ndarray]:
        levels = [x.astype(np.uint8)]
        while 2 << (len(levels) - 1) <= len(x):
            half = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
        return levels

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the parse suffixes of ranks a < b have in common, up to CAP."""
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            own = level == k
            low = self._low[k]
            out[own] = np.minimum(low[a[own] + 1], low[b[own] - (1 << k) + 1])
        return out

    def combine(self, phrase: np.ndarray, offset: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corpus order of the text suffixes at ``offset`` of phrases, each followed by the parse suffix at ``following``.

        Returns the order and, for each place in it, the bytes shared with the place before:
        counted through the parse where both start with the same phrase suffix, else 0.
        """
        alpha, rank = self.d.suffix[self.d.begin[phrase] + offset], self.rank[following]
        order = np.lexsort((rank, alpha))
        a, r = alpha[order], rank[order]
        same = np.flatnonzero(a[1:] == a[:-1]) + 1
        shared = np.zeros(len(order), np.int64)
        tail = (self.d.size[phrase] - offset)[order]
        shared[same] = np.minimum(CAP, tail[same] - self.w + self.shared(r[same - 1], r[same]))
        return order, shared

    def corpus_order(self) -> tuple[np.ndarray, np.ndarray]:
        """(parse place, offset in its phrase) of every text position, in the order of the texts' suffixes."""
        at = np.flatnonzero(self.sequence)
        phrase = self.sequence[at] - 1
        last = self.sequence[at + 1] == 0
        n = np.where(last, self.d.size[phrase], self.d.size[phrase] - self.w)
        place = np.repeat(at, n)
        offset = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
        # what follows a text's last phrase is its separator, which comes before all phrases
        order, _ = self.combine(np.repeat(phrase, n), offset, place + 1)
        return place[order], offset[order]
