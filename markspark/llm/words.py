"""Word hashes of whole Arrow text columns, without Python string objects.

Words are maximal runs of "word bytes" of the UTF-8 text after A-Z is
lower-cased. Each word gets a 64-bit polynomial hash over random byte codes,
computed for all words of a piece at once from prefix sums modulo 2^64.
Pieces are small, so working memory stays near 40 bytes per byte of a piece;
a longer text is hashed piece by piece, cut between words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))

_BYTES = np.arange(256)
#: Everything but blank, tab, line feed, vertical tab, form feed, carriage return.
NOT_SPACE = ~np.isin(_BYTES, [0x20, 9, 10, 11, 12, 13])
#: Digits, lower-case letters (after lower-casing) and all bytes of non-ASCII characters.
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its rows' offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data, off


def _powers_uncached(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _R), np.full(n, _RINV)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_powers_piece = lru_cache(maxsize=1)(lambda: _powers_uncached(PIECE + 1))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers_piece() if n <= PIECE + 1 else _powers_uncached(n)


def word_spans(low: np.ndarray, ends: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in lower-cased bytes; rows end at ``ends``."""
    m = is_word[low]
    before, after = np.zeros(len(m), bool), np.zeros(len(m), bool)
    before[1:], after[:-1] = m[:-1], m[1:]
    cut = ends[(ends > 0) & (ends <= len(m))]
    after[cut - 1] = False
    before[cut[cut < len(m)]] = False
    return np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1


def span_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal spans hash alike wherever they stand."""
    up, down = _powers(len(low) + 1)
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_CODES[low] * up[:len(low)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _long_row(data: np.ndarray, is_word: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, piece by piece; a piece ends between words."""
    parts, at = [], 0
    while at < len(data):
        to = min(at + PIECE, len(data))
        while to < len(data):  # back to the last byte that is in no word, else further on
            gaps = np.flatnonzero(~is_word[LOWER[data[at:to]]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
                break
            to = min(to + PIECE, len(data))
        low = LOWER[data[at:to]]
        parts.append(span_hashes(low, *word_spans(low, np.array([len(low)]), is_word)))
        at = to
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def pieces(off: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of at most ``size`` bytes; a longer row stands alone."""
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + size, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def row_words(col, is_word: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word offsets of the rows, word hashes) for runs of rows, in order."""
    data, off = column_bytes(col)
    for a, b in pieces(off):
        chunk = data[off[a]:off[b]]
        if len(chunk) > PIECE:
            h = _long_row(chunk, is_word)
            yield a, np.array([0, len(h)]), h
            continue
        low = LOWER[chunk]
        ends = off[a + 1:b + 1] - off[a]
        start, end = word_spans(low, ends, is_word)
        yield a, np.searchsorted(start, np.concatenate([[0], ends])), span_hashes(low, start, end)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive words (len(words) - k + 1 of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(k))
    for i in range(k):
        h = (h ^ words[i:i + n]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return mix(h)
