"""A compressed FM-index over a sequence of integers, and the matching statistics of sequences that stream past it.

Kept of a text of n symbols: a wavelet matrix over its Burrows-Wheeler transform, one bit vector with rank a level; the
suffix array at every SAMPLE-th place of the text, the others found by steps of the transform; and, in a byte a row, how many
symbols neighbouring suffixes share, up to the length that matches are wanted for.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
SAMPLE = 8


class Bits:
    """A bit vector with rank: 64 bits a word, and the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        self.words = np.zeros(len(bits) // 64 + 1, U)
        packed = np.packbits(bits, bitorder="little")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64))).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        below = self.words[w] & ((U(1) << (i & 63).astype(U)) - U(1))
        return self.before[w] + np.bitwise_count(below).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(U) & U(1)).astype(np.int64)


class WaveletMatrix:
    """``rank(c, i)``: how often symbol c occurs before position i, for arrays of both, in one bit vector's rank a level."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels, self.zeros = [], []
        self.depth = max(1, int(sigma - 1).bit_length())
        x = symbols
        for level in range(self.depth - 1, -1, -1):
            b = (x >> level) & 1
            self.levels.append(Bits(b.astype(np.uint8)))
            self.zeros.append(len(x) - int(b.sum()))
            x = np.concatenate((x[b == 0], x[b == 1]))
        self.first = self.descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits, zeros in zip(range(self.depth - 1, -1, -1), self.levels, self.zeros, strict=True):
            ones = bits.rank(i)
            i = np.where((c >> level) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.descend(c, i) - self.first[c]

    def read(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at position i, how often it occurs before)."""
        c = np.zeros(len(i), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            b, ones = bits.get(i), bits.rank(i)
            i, c = np.where(b == 1, zeros + ones, i - ones), c << 1 | b
        return c, i - self.first[c]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the sorted suffixes of a text whose last symbol occurs once and is the least. Ranks by prefixes that double."""
    n, width = len(text), int(text.max()).bit_length() + 1
    reach, key = 1, text.astype(np.int64) + 1
    while (reach + 1) * width < 62 and reach < n:  # as many symbols at once as a number holds; 0 is past the end
        key = key << width | np.append(text[reach:].astype(np.int64) + 1, np.zeros(min(reach, n), np.int64))
        reach += 1
    while True:
        kinds, rank = np.unique(key, return_inverse=True)
        rank = rank.reshape(-1)
        if len(kinds) == n:
            break
        nxt = np.zeros(n, np.int64)
        nxt[: n - reach] = rank[reach:] + 1
        key, reach = rank * (len(kinds) + 1) + nxt, reach * 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class FMIndex:
    """Index of ``text``: symbols 2..sigma-1, 1 after each segment, and one 0 at the end.

    Matches are of symbols from 2 on and of at most ``longest``.
    """

    def __init__(self, text: np.ndarray, sigma: int, longest: int):
        self.n, self.longest = len(text), longest
        suffixes = suffix_array(text)
        self.bwt = WaveletMatrix(text[suffixes - 1], sigma)
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        sampled = suffixes % SAMPLE == 0
        self.marks, self.samples = Bits(sampled), (suffixes[sampled] // SAMPLE).astype(np.int32)
        #: shared[i]: symbols that row i shares with the row before, at most ``longest``; 0 at both ends.
        self.shared, open_ = np.zeros(self.n + 1, np.uint8), np.arange(1, self.n)
        for k in range(longest):
            a, b = suffixes[open_ - 1] + k, suffixes[open_] + k
            inside = (a < self.n) & (b < self.n)
            open_, a, b = open_[inside], a[inside], b[inside]
            open_ = open_[text[a] == text[b]]
            self.shared[open_] = k + 1

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the suffixes that start with c and go on as those of the intervals do."""
        both = self.bwt.rank(np.concatenate((c, c)), np.concatenate((lo, hi)))
        return self.starts[c] + both[: len(c)], self.starts[c] + both[len(c) :]

    def edge(self, at: np.ndarray, least: np.ndarray, way: int) -> np.ndarray:
        """The nearest row from ``at`` on, downwards (way -1) or upwards (1), that shares less than ``least`` with the row before."""
        out, live, width = at.copy(), np.arange(len(at)), 16
        while len(live):
            rows = np.clip(out[live, None] + way * np.arange(width), 0, self.n)
            hit = self.shared[rows] < least[live, None]
            found = hit.any(axis=1)
            out[live] = np.where(found, rows[np.arange(len(live)), hit.argmax(axis=1)], np.clip(out[live] + way * width, 0, self.n))
            live, width = live[~found], min(2 * width, 4096)
        return out

    def shorter(self, lo: np.ndarray, hi: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first ``length`` symbols of what the intervals stand for."""
        return self.edge(lo, length, -1), self.edge(hi, length, 1)

    def statistics(self, text: np.ndarray, first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, lo, hi) by position of ``text``, within the streams text[first:after]: the longest match that starts there, and its interval.

        A stream is read from its end. Each symbol extends the match of the place behind it; where nothing goes on that way the
        match is cut to its next shorter interval until something does, and a match longer than ``longest`` to that length.
        Streams go on side by side.
        """
        length, low, high = (np.zeros(len(text), np.int64) for _ in range(3))
        order = np.argsort(first - after, kind="stable")  # longest first, so that live ones stay in front
        at, left = after[order], after[order] - first[order]
        n, lo, hi = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), np.full(len(order), self.n)
        for step in range(1, int(left[0]) + 1 if len(left) else 1):
            k = int(np.searchsorted(-left, -step, "right"))
            n, lo, hi = n[:k], lo[:k], hi[:k]
            place = at[:k] - step
            c = text[place]
            a, b = self.extend(c, lo, hi)
            stuck = np.flatnonzero((a >= b) & (n > 0))
            while len(stuck):
                cut = np.maximum(self.shared[lo[stuck]], self.shared[hi[stuck]]).astype(np.int64)
                cut = np.minimum(cut, n[stuck] - 1)
                whole = cut <= 0
                x, y = self.shorter(lo[stuck], hi[stuck], np.maximum(cut, 1))
                lo[stuck], hi[stuck], n[stuck] = np.where(whole, 0, x), np.where(whole, self.n, y), np.maximum(cut, 0)
                a[stuck], b[stuck] = self.extend(c[stuck], lo[stuck], hi[stuck])
                stuck = stuck[(a[stuck] >= b[stuck]) & (n[stuck] > 0)]
            none = a >= b  # a symbol that the index lacks
            lo, hi, n = np.where(none, 0, a), np.where(none, self.n, b), np.where(none, 0, n + 1)
            long = np.flatnonzero(n > self.longest)
            if len(long):
                n[long] = self.longest
                lo[long], hi[long] = self.shorter(lo[long], hi[long], n[long])
            length[place], low[place], high[place] = n, lo, hi
        return length, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows start: steps back through the transform to the next sampled one."""
        out, live, at, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(live):
            hit = self.marks.get(at) == 1
            out[live[hit]] = self.samples[self.marks.rank(at[hit])].astype(np.int64) * SAMPLE + steps
            live, at = live[~hit], at[~hit]
            c, before = self.bwt.read(at)
            at, steps = self.starts[c] + before, steps + 1
        return out
