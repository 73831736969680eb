"""Operator 10: BPE encoding and decoding, long texts by tree concatenation.

A vocabulary file of the tokenizers library is applied to whole texts.

* Ordinary texts are encoded in the scan, one Arrow batch after the other. BPE
  merges never cross the words of the pre-tokeniser, so a word's ids are kept
  in a bounded table and each distinct word is merged once per worker.
* A text longer than ``PIECE`` characters is cut into pieces, which are dealt
  over the cluster and encoded in parallel. White space is a safe place to cut.
  A stretch without any is pre-tokenised, and a word in it that is still long
  ("unsplit") is cut anywhere, into halves and halves of halves. The ids of
  neighbouring parts are then joined in a tree: a window of tokens around the
  join is encoded again and grown until its first token equals the left
  side's and its last the right side's. An id sequence is the BPE encoding of
  its text exactly if every two neighbouring ids are the encoding of theirs,
  so such a join is the encoding of the whole.
* Equal long texts are encoded once.

Decoding maps ids to their strings and joins them as the file's decoder does
(without a decoder: with single blanks).

Defined results: a null text encodes as an empty one; strings of special
tokens inside a text become those tokens; repeated rows each get their result.
"""

from __future__ import annotations

import json
import re
import struct
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markspark.llm.common import give_back, stored

#: Characters of a text, or of a word's symbols, encoded at once.
PIECE = 65_536
#: Blank-separated chunks kept in a worker's table, and the longest one kept.
TABLE_WORDS, TABLE_CHARS = 60_000, 64
#: Characters that NFC leaves alone, whose lower case is one character and whose classes all libraries share.
_PLAIN = re.compile("[\t\n\r\x20-\x7E\xA1-\u012F\u0131-\u017E]*")
#: Byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on (fixed rule).
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SYMBOLS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}


class _Table(dict):
    """Chunk -> ids, filled on demand, and ``text``: chunk -> decoded text. Trimmed between texts:
    a full table becomes the old one, from which chunks that are used again come back."""

    def __init__(self, merge):
        super().__init__()
        self.merge, self.text, self.old, self.long = merge, {}, ({}, {}), []

    def __missing__(self, chunk):
        ids = self.old[0].get(chunk)
        if ids is None:
            ids, text = self.merge(chunk)
        else:
            text = self.old[1][chunk]
        self[chunk], self.text[chunk] = ids, text
        if len(chunk) > TABLE_CHARS:
            self.long.append(chunk)
        return ids

    def trim(self):
        for chunk in self.long:
            del self[chunk], self.text[chunk]
        self.long = []
        if len(self) > TABLE_WORDS:  # a worker is used again by other stages, so what it keeps has to stay small
            self.old = dict(self), self.text
            self.clear()
            self.text = {}


class Codec:
    """A vocabulary file: words to ids, ids to text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(self.tok.to_str())
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.final = self.tok.model
        self.names = {i: s for s, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.decoder = self.tok.decoder
        self.word = self._word_pattern(spec)
        self.table = _Table(self._merge)

    @cached_property
    def inner(self):
        """The model for a word's part that goes on: without the end-of-word suffix. Few texts have words that need it, so the
        file's merges are read again for them instead of being kept by every worker."""
        from tokenizers import models

        if not self.suffix:
            return self.final
        model = json.loads(self.tok.to_str())["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        return models.BPE(vocab=model["vocab"], merges=merges)

    @staticmethod
    def _word_pattern(spec: dict):
        """The pattern of the words, if the file is of the kind whose words can be told apart beforehand:
        NFC, white space to blanks, lower case; then matches of one pattern; then byte-level BPE."""
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        kinds = [n["type"] for n in norm.get("normalizers", [])]
        steps = pre.get("pretokenizers", [])
        if kinds == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in steps] == ["Split", "ByteLevel"] \
                and steps[0]["invert"] and steps[0]["behavior"] == "Removed" and not steps[1]["add_prefix_space"] \
                and not steps[1]["use_regex"] and not spec.get("decoder"):
            return regex.compile(steps[0]["pattern"]["Regex"])
        return None

    def plain(self, text: str) -> bool:
        return self.word is not None and _PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def _merge(self, chunk: str) -> tuple[bytes, str]:
        if len(chunk) > 1 and not chunk.isalpha() and chunk[:-1].isalpha():  # a word and one more character
            table = self.table
            return table[chunk[:-1]] + table[chunk[-1]], f"{table.text[chunk[:-1]]} {table.text[chunk[-1]]}"
        words = [chunk] if chunk.isalpha() else self.word.findall(chunk)
        ids = [i for w in words for i in self.encode_word(self.symbols(w), True, 4096)]
        return struct.pack(f"<{len(ids)}I", *ids), " ".join([self.names[i] for i in ids])

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, decoded text) of every text."""
        out: list = []
        for t in texts:
            if not self.plain(t):
                ids = self.tok.encode(t, add_special_tokens=False).ids
                out.append((np.array(ids, "<u4").tobytes(), self.decode(ids)))
                continue
            chunks = t.lower().split()  # white space is in no word
            ids = b"".join(map(self.table.__getitem__, chunks))
            out.append((ids, " ".join(map(self.table.text.__getitem__, chunks))))
            self.table.trim()
        return out

    def count(self, text: str) -> int:
        """Number of tokens of a text."""
        if not self.plain(text):
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        n = sum(map(len, map(self.table.__getitem__, text.lower().split()))) // 4
        self.table.trim()
        return n

    def decode(self, ids) -> str:
        if self.decoder is not None:
            return self.tok.decode(list(map(int, ids)), skip_special_tokens=False)
        return " ".join([self.names[i] for i in ids])

    # --- long stretches without white space ---

    def stretch_words(self, stretch: str) -> list[tuple[str, bool]]:
        """(symbols or special token, is special) of a stretch's words in order."""
        out = []
        pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        for i, part in enumerate(pattern.split(stretch) if pattern else [stretch]):
            if i % 2:
                out.append((part, True))
            elif part:
                norm = self.tok.normalizer.normalize_str(part) if self.tok.normalizer else part
                out += [(s, False) for s, _ in self.tok.pre_tokenizer.pre_tokenize_str(norm)]
        return out

    @staticmethod
    def symbols(word: str) -> str:
        """The byte-level alphabet's characters of a word."""
        return word if word.isascii() else "".join([_SYMBOLS[b] for b in word.encode()])

    def encode_word(self, symbols: str, ends: bool, leaf: int = 512) -> list[int]:
        """ids of one word's symbols (``ends``: with the word's end), by halves."""
        if len(symbols) <= leaf:
            return [t.id for t in (self.final if ends else self.inner).tokenize(symbols)] if symbols else []
        half = len(symbols) // 2
        return self.join(self.encode_word(symbols[:half], False, leaf), self.encode_word(symbols[half:], ends, leaf), ends)

    def join(self, left: list[int], right: list[int], ends: bool) -> list[int]:
        """The encoding of left's and right's text together, from a growing window around the join."""
        n = 2
        while True:
            a, b = max(0, len(left) - n), min(n, len(right))
            whole = b == len(right)
            text = "".join([self.names[i] for i in left[a:] + right[:b]])
            if ends and whole and self.suffix:
                text = text.removesuffix(self.suffix)
            mid = [t.id for t in (self.final if ends and whole else self.inner).tokenize(text)] if text else []
            if (a == 0 or mid[:1] == left[a:a + 1]) and (whole or mid[-1:] == right[b - 1:b]):
                return left[:a] + mid + right[b:]
            n *= 2


@lru_cache(maxsize=2)
def _codec(path: str) -> Codec:
    return Codec(path)


_PIECES = "th string, seq long, special boolean, payload string, goes_on boolean, plain boolean"


def _cut(text: str, codec: Codec, piece: int):
    """(payload, special, goes_on, plain) for the pieces of a long text.

    plain: text between safe cuts. Otherwise the symbols of a stretch's words, one blank between
    words; goes_on: the last word continues in the next piece."""
    white = regex.compile(r"[ \t\n\r]")
    at = 0
    while at < len(text):
        to = at + piece
        if to >= len(text):
            yield text[at:], False, False, True
            return
        back = max(text.rfind(c, at + 1, to) for c in " \n\t\r")
        if back > at:
            yield text[at:back], False, False, True
            at = back
            continue
        after = white.search(text, to)
        end = after.start() if after else len(text)
        yield from _cut_stretch(codec.stretch_words(text[at:end]), piece)
        at = end


def _cut_stretch(words, piece: int):
    held, size = [], 0
    for symbols, special in words:
        if special:
            if held:
                yield " ".join(held), False, False, False
                held, size = [], 0
            yield symbols, True, False, False
            continue
        while size + len(symbols) > piece:
            room = piece - size
            yield " ".join([*held, symbols[:room]]), False, room < len(symbols), False
            symbols, held, size = symbols[room:], [], 0
        if symbols:
            held.append(symbols)
            size += len(symbols)
    if held:
        yield " ".join(held), False, False, False


def _encode_piece(codec: Codec, payload: str, special: bool, goes_on: bool, plain: bool):
    """(ids, tokens of the first word, tokens of the last word) of one piece."""
    if plain:
        return list(np.frombuffer(codec.encode([payload])[0][0], "<u4").tolist()), 0, 0
    if special:
        return [codec.tok.token_to_id(payload)], 0, 0
    words = payload.split(" ")
    each = [codec.encode_word(w, not (goes_on and i == len(words) - 1)) for i, w in enumerate(words)]
    return [x for ids in each for x in ids], len(each[0]), len(each[-1])


def _tree(codec: Codec, parts: list[tuple]) -> list[int]:
    """Join pieces (ids, first, last, words, goes_on) pairwise, level by level."""
    while len(parts) > 1:
        level = []
        for i in range(0, len(parts) - 1, 2):
            a, b = parts[i], parts[i + 1]
            if not a[4]:
                level.append((a[0] + b[0], a[1], b[2], a[3] + b[3], b[4]))
                continue
            ends = not (b[3] == 1 and b[4])
            cut = len(a[0]) - a[2]
            word = codec.join(a[0][cut:], b[0][:b[1]], ends)
            level.append((a[0][:cut] + word + b[0][b[1]:], len(word) if a[3] == 1 else a[1],
                          len(word) if b[3] == 1 else b[2], a[3] + b[3] - 1, b[4]))
        parts = level + parts[len(parts) - len(parts) % 2:]
    return parts[0][0] if parts else []


def encode(docs: DataFrame, path: str, piece: int = PIECE) -> DataFrame:
    """(doc_id, ids, decoded) for every row of ``docs(doc_id, text)``: ids as
    little-endian 32-bit integers, decoded the text that they decode to."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]

    def short(batches):
        codec = _codec(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = codec.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found], pa.binary()),
                                                  pa.array([x for _, x in found], pa.string())], names=["doc_id", "ids", "decoded"])
        codec.table.old = {}, {}
        give_back()

    def cut(batches):
        codec = _codec(path)
        for batch in batches:
            for th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(th, i, s, p, g, plain) for i, (p, s, g, plain) in enumerate(_cut(text, codec, piece))]
                yield pa.RecordBatch.from_pylist([dict(zip(("th", "seq", "special", "payload", "goes_on", "plain"), r, strict=True))
                                                  for r in rows],
                                                 schema=pa.schema([("th", pa.string()), ("seq", pa.int64()), ("special", pa.bool_()),
                                                                   ("payload", pa.string()), ("goes_on", pa.bool_()), ("plain", pa.bool_())]))

    def encode_pieces(batches):
        codec = _codec(path)
        for batch in batches:
            for th, seq, special, payload, goes_on, plain in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, first, last = _encode_piece(codec, payload, special, goes_on, plain)
                words = 0 if plain or special else payload.count(" ") + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([th]), pa.array([seq]), pa.array([np.array(ids, "<u4").tobytes()], pa.binary()), pa.array([first]),
                     pa.array([last]), pa.array([words]), pa.array([goes_on])],
                    names=["th", "seq", "ids", "first", "last", "words", "goes_on"])

    def concatenate(batches):
        codec, key, parts = _codec(path), None, []

        def done():
            ids = _tree(codec, parts)
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([np.array(ids, "<u4").tobytes()], pa.binary()),
                                               pa.array([codec.decode(ids)])], names=["th", "ids", "decoded"])

        for batch in batches:
            for th, _, ids, first, last, words, goes_on in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if th != key:
                    if parts:
                        yield done()
                    key, parts = th, []
                parts.append((np.frombuffer(ids, "<u4").tolist(), first, last, words, goes_on))
        if parts:
            yield done()

    out = f"doc_id {kind}, ids binary, decoded string"
    ordinary = docs.filter(F.length("text") <= piece).mapInArrow(short, out)
    long = docs.filter(F.length("text") > piece).withColumn("th", F.sha2("text", 256))
    distinct = long.groupBy("th").agg(F.first("text").alias("text"))
    pieces = stored(distinct.mapInArrow(cut, _PIECES), "pieces")
    encoded = (pieces.repartition(F.col("th"), F.col("seq"))
               .mapInArrow(encode_pieces, "th string, seq long, ids binary, first long, last long, words long, goes_on boolean")
               .repartition("th").sortWithinPartitions("th", "seq").mapInArrow(concatenate, "th string, ids binary, decoded string"))
    return ordinary.unionByName(long.select("doc_id", "th").join(encoded, "th").select("doc_id", "ids", "decoded"))
