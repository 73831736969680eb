"""md5 numbers of many short texts at once, for seeded draws.

The numbers are those of :func:`markspark.functions.numeric.md5_unit` with 15 digits: the first 60 bits of the md5 of
``seed|round|...``. A text of up to 55 bytes is one block of 16 words, so md5's 64 steps are array operations over all
texts; longer texts are hashed one by one. The functions are made here, as what a function makes is sent to the
workers whole and needs no package there.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np


def md5_heads():
    """A function of 16 words (each an int or an array of uint32: padded texts, little-endian) and their number, giving the
    first 60 bits of every md5."""
    shifts = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
    steps = []
    for i in range(64):
        g = (i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16)[i // 16]
        steps.append((i // 16, g, int(abs(math.sin(i + 1)) * 2**32), np.uint32(shifts[i // 16][i % 4])))

    def heads(words, n):
        start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
        a, b, c, d = (np.full(n, x, np.uint32) for x in start)
        f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
        for kind, g, k, left in steps:
            if kind == 0:
                np.bitwise_xor(c, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
            elif kind == 1:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_xor(f, c, out=f)
            elif kind == 2:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
            else:
                np.invert(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
            np.add(f, a, out=f)
            word = words[g]
            if isinstance(word, int):
                np.add(f, np.uint32((k + word) & 0xFFFFFFFF), out=f)
            else:
                np.add(f, word, out=f)
                np.add(f, np.uint32(k), out=f)
            np.left_shift(f, left, out=t)
            np.right_shift(f, np.uint32(32) - left, out=f)
            np.bitwise_or(f, t, out=f)
            np.add(f, b, out=f)
            a, d, c, b, f = d, c, b, f, a  # the old a is free
        a += start[0]
        b += start[1]
        return (a.byteswap().astype(np.uint64) << np.uint64(28)) | (b.byteswap().astype(np.uint64) >> np.uint64(4))

    return heads


def counted_heads(lanes: int = 1 << 14):
    """A function of a list of prefixes (bytes) and a range [lo, hi) of numbers: for each run of numbers (first, last + 1) and
    each prefix, (first, which prefix, the first 60 bits of the md5 of every ``<prefix><number>``)."""
    heads = md5_heads()

    def of(prefixes, lo, hi):
        while lo < hi:
            size = len(str(lo))
            to = min(hi, 10 ** size, lo + lanes)
            left, digits = np.arange(lo, to, dtype=np.int64), []
            for _ in range(size):
                left, digit = np.divmod(left, 10)
                digits.append((digit + 48).astype(np.uint32))
            digits.reverse()
            for i, prefix in enumerate(prefixes):
                whole = len(prefix) + size
                if whole > 55:
                    yield lo, i, np.array([int.from_bytes(hashlib.md5(prefix + str(k).encode()).digest()[:8]) >> 4
                                           for k in range(lo, to)], np.uint64)
                    continue
                block = prefix + bytes(size) + b"\x80" + bytes(55 - whole) + (8 * whole).to_bytes(8, "little")
                words = [int.from_bytes(block[4 * w:4 * w + 4], "little") for w in range(16)]
                for j, digit in enumerate(digits, len(prefix)):
                    w, by = divmod(j, 4)
                    placed = digit << np.uint32(8 * by)
                    words[w] = (placed | np.uint32(words[w])) if isinstance(words[w], int) else words[w] | placed
                yield lo, i, heads(words, to - lo)
            lo = to

    return of


def text_heads(lanes: int = 1 << 14):
    """A function of a list of prefixes (bytes) and texts (their UTF-8 bytes and offsets): for runs of rows and each prefix,
    (rows, which prefix, the first 60 bits of the md5 of every ``<prefix><text>``)."""
    heads = md5_heads()

    def blocks(data, start, size, at):
        """Words of the texts, each placed after ``at`` bytes."""
        most = int(size.max())
        place = np.arange(most)
        inside = place < size[:, None]
        block = np.zeros((len(size), 64), np.uint8)
        block[:, at:at + most][inside] = data[(start[:, None] + place)[inside]]
        block[np.arange(len(size)), at + size] = 0x80
        words = list(np.ascontiguousarray(block.view("<u4").T))
        used = (at + most) // 4 + 1
        words[used:] = [0] * (16 - used)
        words[14] = (8 * (at + size)).astype(np.uint32)
        return words

    def of(prefixes, data, off):
        sizes, room = np.diff(off), 55 - max((len(p) for p in prefixes), default=0)
        for rows in [x for x in [np.flatnonzero(sizes > room)] if len(x)]:
            texts = [data[off[r]:off[r + 1]].tobytes() for r in rows]
            for i, prefix in enumerate(prefixes):
                yield rows, i, np.array([int.from_bytes(hashlib.md5(prefix + t).digest()[:8]) >> 4 for t in texts], np.uint64)
        short = np.flatnonzero(sizes <= room)
        for first in range(0, len(short), lanes):
            rows, made = short[first:first + lanes], {}
            for i, prefix in enumerate(prefixes):
                at = len(prefix)
                if at not in made:  # prefixes of one length differ in a few words only
                    made[at] = blocks(data, off[rows], sizes[rows], at)
                words = list(made[at])
                for w in range(-(-at // 4)):
                    own = int.from_bytes(prefix[4 * w:4 * w + 4], "little")
                    words[w] = words[w] | (own if isinstance(words[w], int) else np.uint32(own))
                yield rows, i, heads(words, len(rows))

    return of
