"""Operator 12: spelling variants, by search schemes over bidirectional FM-indexes.

Two words are near if they differ by exactly one inserted, deleted or replaced
code point. Then one of them has the other's left half at its start, or the
other's right half at its end, unchanged. So each word is searched twice: its
left half exactly and one error across the rest, its right half exactly and
one error across the rest (:mod:`markspark.llm.fm_index`).

The vocabulary is never in one task. For the first search it is range-parted
by the words into blocks of about ``BLOCK``, for the second by the reversed
words; each block has its own index over the delimited words. All words with
one left half are then neighbours, so a word has to be searched in one block, or
in the few that its half spans. The blocks' least words (a list of V / BLOCK
entries of up to 64 code points) are all that the routing needs. Equal words
are counted in the scan, so frequent ones are no hot keys.

A word's form is its near word with the largest count, if that is ``RATIO`` times
its own; the root is found by pointer doubling along the forms (counts grow
by RATIO a step, so chains are short).

Defined results: a null text has no words; a null id deletes no code point; rows
that repeat count again; words of one code point or none have no near words
that are shorter; of several near words with the largest count the smallest in
code-point order is the form; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markspark.llm.common import hashed_blocks, stored
from markspark.llm.fm_index import BATCH, Index
from markspark.llm.words import LOWER, column_bytes

#: Words in a block, about.
BLOCK = 20_000
#: A form is at least so many times as frequent.
RATIO = 5
#: Code points by which blocks are told apart.
_KEY = 64
_RUN = re.compile("[a-zÀ-ÿ]+")
#: Distinct words that a task holds before it passes its counts on; text length from which matches are not listed at once.
_HELD, _LONG = 400_000, 1 << 20


def _runs(text: str):
    return Counter(_RUN.findall(text) if len(text) < _LONG else (m.group() for m in _RUN.finditer(text)))


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """(word, n) of ``docs(doc_id, text)``: runs of letters, A-Z lower-cased. Where ``every`` divides the checksum h of
    "doc_id:run", code point h % length of the run is deleted first."""
    def count(batches):
        held: Counter = Counter()

        def out():
            found = [(w, n) for w, n in held.items() if len(w) >= least_length]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())],
                                              names=["word", "n"])

        for batch in batches:
            data, off = column_bytes(batch.column(1))
            for i, doc in enumerate(batch.column(0).to_pylist()):
                runs = _runs(LOWER[data[off[i]:off[i + 1]]].tobytes().decode())
                if doc is None:
                    held.update(runs)
                    continue
                begin = zlib.crc32(f"{doc}:".encode())
                for w, n in runs.items():
                    h = zlib.crc32(w.encode(), begin)
                    if h % every == 0:
                        w = w[:h % len(w)] + w[h % len(w) + 1:]
                    held[w] += n
                if len(held) > _HELD:
                    yield out()
                    held.clear()
        yield out()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return (rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= least_count))


def _blocks(words: DataFrame, left: bool, n: int) -> tuple[DataFrame, list[str]]:
    """``words`` with their block, and each block's least key; the key is the word or, for right halves, the reversed word."""
    key = F.col("word") if left else F.reverse("word")
    parted = words.select("word", "n", key.alias("__key")).repartitionByRange(n, "__key")
    parted = stored(parted.withColumn("block", F.spark_partition_id()), "blocks")
    least = parted.groupBy("block").agg(F.substring(F.min("__key"), 1, _KEY).alias("least")).collect()  # one row a block
    least = sorted((r.least, r.block) for r in least)
    number = {b: i for i, (_, b) in enumerate(least)}  # blocks without words have no number
    numbers = F.element_at(F.create_map(*[F.lit(x) for kv in number.items() for x in kv]), F.col("block")) if number else F.col("block")
    return parted.select("word", "n", numbers.alias("block")), [x for x, _ in least]


def _routed(words: DataFrame, left: bool, least: list[str]) -> DataFrame:
    """(block, word, n) for every block that may hold words with the word's half."""
    def route(batches):
        for batch in batches:
            rows = []
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                half = (w[:len(w) // 2] if left else w[len(w) // 2:][::-1])[:_KEY]
                for b in range(max(bisect_left(least, half) - 1, 0), bisect_right(least, half + "\U0010FFFF")):
                    rows.append((b, w, n))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()),
                                              pa.array([r[2] for r in rows], pa.int64())], names=["block", "word", "n"])

    return words.select("word", "n").mapInArrow(route, "block int, word string, n long")


def _search(left: bool):
    """Sorted rows (block, asked, word, n), a block's words and then its searches, to pairs (word, near, near_n)."""
    def run(batches):
        def flush():
            pairs = [(w, index.words[v], counts[v]) for w, v in index.search(asked, left)
                     if left or not index.words[v].startswith(w[:len(w) // 2])]  # those are found by the left half
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string()),
                                               pa.array([p[2] for p in pairs], pa.int64())], names=["word", "near", "near_n"])

        block, words, counts, index, asked = None, [], [], None, []
        for batch in batches:
            for b, ask, w, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != block:
                    if asked:
                        yield flush()
                    block, words, counts, index, asked = b, [], [], None, []
                if not ask:
                    words.append(w)
                    counts.append(n)
                    continue
                if index is None:
                    index = Index(words)
                asked.append(w)
                if len(asked) == BATCH:
                    yield flush()
                    asked = []
        if asked:
            yield flush()

    return run


def near_words(words: DataFrame, per_block: int = BLOCK) -> DataFrame:
    """(word, near, near_n): every ordered pair of near words of ``words(word, n)`` (distinct, not null), once."""
    n = hashed_blocks(words.count(), per_block)
    pairs = None
    for left in (True, False):
        parted, least = _blocks(words, left, n)
        rows = parted.select("block", F.lit(False).alias("asked"), "word", "n").unionByName(
            _routed(words, left, least).select("block", F.lit(True).alias("asked"), "word", "n"))
        rows = rows.repartition(n, "block").sortWithinPartitions("block", "asked", "word")
        found = rows.mapInArrow(_search(left), "word string, near string, near_n long")
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms(word, form)``: the last word along the forms, by pointer doubling."""
    to = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = to.select(F.col("word").alias("__at"), F.col("root").alias("__to"))
        step = stored(to.join(on, to["root"] == on["__at"], "left").select(
            "word", F.coalesce("__to", "root").alias("root"), F.col("__to").isNotNull().alias("moved")), "roots")
        to = step.select("word", "root")
        if not step.filter("moved").limit(1).count():
            return to


def variants(words: DataFrame, per_block: int = BLOCK, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for ``words(word, n)``."""
    words = stored(words, "vocabulary")
    best = near_words(words, per_block).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(best, "word", "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    found = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                F.when(is_form, F.col("best.near")).alias("form"),
                                F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
