"""A bidirectional FM-index over a block of words, and searches with exactly one error.

The words stand one after the other, each behind a delimiter, in one cyclic
text. Its rotations in sorted order, and those of the reversed text, give two
Burrows-Wheeler transforms; a pattern is an interval of sorted rotations
(suffix ranks) in both, and can be made longer at either end: counting symbols
in the interval of one transform gives the new interval there, counting the
smaller symbols moves the other one. The transforms are held as wavelet
matrices, and many patterns are extended at once.
"""

from __future__ import annotations

from itertools import chain

import numpy as np

#: Patterns searched at once.
BATCH = 4096


class Wavelet:
    """Symbol counts in intervals of a sequence of small integers."""

    def __init__(self, s: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            bit = (s >> b & 1).astype(bool)
            ones = np.zeros(len(s) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((b, ones, len(s) - int(ones[-1])))
            s = np.concatenate([s[~bit], s[bit]])
        self.start, _, _ = self._down(np.arange(1 << bits), np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64))

    def _down(self, c, lo, hi):
        less = np.zeros(len(c), np.int64)
        for b, ones, zeros in self.levels:
            bit = (c >> b & 1).astype(bool)
            l1, h1 = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            less += np.where(bit, hi - lo - (h1 - l1), 0)
            lo, hi = np.where(bit, zeros + l1, lo - l1), np.where(bit, zeros + h1, hi - h1)
        return lo, hi, less

    def count(self, c, lo, hi):
        """(c's before lo, c's in [lo, hi), smaller symbols in [lo, hi)) for arrays of queries."""
        a, b, less = self._down(c, lo, hi)
        return a - self.start[c], b - a, less

    def symbols(self, lo, hi):
        """Every distinct symbol of each interval: (interval, symbol, its :meth:`count`)."""
        q, c, less = np.arange(len(lo)), np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        for _, ones, zeros in self.levels:
            l1, h1 = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            l0, h0 = lo - l1, hi - h1
            z, o = h0 > l0, h1 > l1
            q, less = np.concatenate([q[z], q[o]]), np.concatenate([less[z], (less + h0 - l0)[o]])
            c = np.concatenate([c[z] << 1, c[o] << 1 | 1])
            lo, hi = np.concatenate([l0[z], zeros + l1[o]]), np.concatenate([h0[z], zeros + h1[o]])
        return q, c, lo - self.start[c], hi - lo, less


def rotations(s: np.ndarray, bits: int) -> np.ndarray:
    """Starts of the cyclic text's rotations in sorted order, by prefix doubling."""
    n, k = len(s), 62 // bits
    key = np.zeros(n, np.int64)
    for i in range(k):
        key = key << bits | np.roll(s, -i)
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        if k >= n or rank[order[-1]] == n - 1:
            return order
        key = rank * n + np.roll(rank, -k)
        k *= 2


class Index:
    """The index of a block of distinct words; symbol 0 is the delimiter."""

    def __init__(self, words: list[str]):
        self.words = words
        points = np.fromiter(map(ord, chain.from_iterable("\0" + w for w in words)), np.int64)
        self.alphabet = np.unique(points)
        self.bits = max(1, len(self.alphabet).bit_length())
        text = np.searchsorted(self.alphabet, points)
        self.starts = np.flatnonzero(text == 0)
        self.place = rotations(text, self.bits)
        back = text[::-1]
        self.left = Wavelet(text[self.place - 1], self.bits)
        self.right = Wavelet(back[rotations(back, self.bits) - 1], self.bits)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.bits))])[:1 << self.bits]

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all texts, each ended by the delimiter, and where each text starts); unknown ones have no occurrence."""
        points = np.fromiter(map(ord, chain.from_iterable(t + "\0" for t in texts)), np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        start = np.cumsum([0] + [len(t) + 1 for t in texts])
        return np.where(self.alphabet[at] == points, at, len(self.alphabet)), start

    def step(self, side: Wavelet, c, a, b, n):
        """Patterns with intervals (a in ``side``, b in the other transform, n rows), made longer by symbols c."""
        before, found, less = side.count(c, a, a + n)
        return self.smaller[c] + before, b + less, found

    def exact(self, side: Wavelet, texts: list[str]):
        """Intervals of patterns that grow to ``side``, symbol by symbol and then by a delimiter: (text, a, b, n) where found."""
        flat, start = self.codes(texts)
        size = np.diff(start)
        q = np.arange(len(texts))
        a, b, n = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), len(self.place))
        out, j = [], 0
        while len(q):
            a, b, n = self.step(side, flat[start[q] + j], a, b, n)
            j += 1
            done = (size[q] == j) & (n > 0)
            out.append((q[done], a[done], b[done], n[done]))
            go = (size[q] > j) & (n > 0)
            q, a, b, n = q[go], a[go], b[go], n[go]
        return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [q, a, b, n]

    def one_error(self, side: Wavelet, texts: list[str], q, a, b, n):
        """Extend intervals to ``side`` across texts[q] with exactly one inserted, deleted or replaced symbol and then the
        delimiter: (text, a, b) of each pattern found."""
        flat, start = self.codes(texts)
        size = np.diff(start) - 1
        held = [np.zeros(0, np.int64)] * 5  # with one error: text, place in it, a, b, n
        out, j = [], 0
        while len(q) or len(held[0]):
            if len(held[0]):  # the rest without error
                eq, ej, ea, eb, en = held
                last = ej == size[eq]
                ea, eb, en = self.step(side, flat[start[eq] + ej], ea, eb, en)
                found = last & (en > 0)
                out.append((eq[found], ea[found], eb[found]))
                go = ~last & (en > 0)
                held = [x[go] for x in (eq, ej + 1, ea, eb, en)]
            if len(q):
                i, c, before, found, less = side.symbols(a, a + n)
                keep = c > 0
                i, c, before, found, less = (x[keep] for x in (i, c, before, found, less))
                ca, cb, cq = self.smaller[c] + before, b[i] + less, q[i]
                inside = j < size[cq]
                same = inside & (flat[start[cq] + j] == c)
                other = inside & ~same
                more = j < size[q]
                at = np.full(len(c), j)
                held = [np.concatenate(x) for x in zip(
                    held, (cq, at, ca, cb, found),  # inserted
                    (cq[other], at[other] + 1, ca[other], cb[other], found[other]),  # replaced
                    (q[more], np.full(more.sum(), j + 1), a[more], b[more], n[more]), strict=True)]  # deleted
                q, a, b, n = cq[same], ca[same], cb[same], found[same]
            j += 1
        return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [q, a, b]

    def search(self, texts: list[str], left: bool):
        """(text, word) for all words at one error from texts: ``left``: those with the text's left half, otherwise those with
        its right half, as a whole; each pair once."""
        for x in range(0, len(texts), BATCH):
            part = texts[x:x + BATCH]
            heads, tails = [t[:len(t) // 2] for t in part], [t[len(t) // 2:] for t in part]
            if left:  # the left half backwards to its delimiter, then on to the right
                q, a, b, n = self.exact(self.left, [h[::-1] for h in heads])
                q, _, row = self.one_error(self.right, tails, q, b, a, n)
            else:  # the right half forwards to its delimiter, then on to the left
                q, a, b, n = self.exact(self.right, tails)
                q, row, _ = self.one_error(self.left, [h[::-1] for h in heads], q, b, a, n)
            word = np.searchsorted(self.starts, self.place[row])
            pairs = np.unique(q * len(self.words) + word)
            for p, w in zip((pairs // len(self.words)).tolist(), (pairs % len(self.words)).tolist(), strict=True):
                yield part[p], w
