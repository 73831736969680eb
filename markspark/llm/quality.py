"""Operator 9: data selection by importance resampling.

Two generative models are bags of hashed n-grams: the target (labelled good
texts) and the raw corpus (all texts). A text's log weight is the sum of
log(p_target / p_raw) over its n-grams; the selection is a sample without
replacement with those weights, drawn as the top k of weight plus Gumbel
noise. k is a share of the rows, or the number of rows over the weight that parts
the labelled good and bad texts with the fewest errors, so that the input's own
mix decides how many stay. The n-grams are byte 5-grams, words, and word pairs (a
repeated word counts as one common pair, as repetition is what matters there).

The raw model counts every text. The target model counts at most
``TARGET_DOCS`` labelled texts, those first in the order of a hash. The k-th
largest key is found by counting keys in ever finer bins, so neither the keys
nor the selection pass through one task, and the noise is a hash of the row,
so a lost task redraws the same numbers.

Defined results: a null or empty text has weight 0; rows repeated with one id
and text have one key and are selected together, as are exact ties at the k-th
key; without any good label all weights are 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markspark.llm.common import give_back, stored
from markspark.llm.words import LOWER, NOT_SPACE, PIECE, column_bytes, mix, pieces, span_hashes, word_spans

#: Labelled good texts that the target model counts (their ids are broadcast: 160 KB).
TARGET_DOCS = 20_000
BITS = 15
KINDS = 3
_SIZE = 1 << BITS
_BINS, _FEW = 4096, 10_000
_PAIR_OF_EQUALS = np.uint64(0x51ED270B0A1F39C1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(64 - BITS)


def _forward(data: np.ndarray, at: int, end: int, word: bool) -> int:
    """The first place from ``at`` on that is in a word (or, ``word`` false, in none), ``end`` if there is none."""
    while at < end:
        found = np.flatnonzero(NOT_SPACE[data[at:min(at + PIECE, end)]] == word)
        if len(found):
            return at + int(found[0])
        at += PIECE
    return end


def _cuts(data: np.ndarray, at: int, end: int):
    """(from, to, seen) for a long row: a piece ends between words, and is seen on to the next word's end and 4 bytes at
    least, so that the grams that start in it are whole."""
    while at < end:
        to, seen = end, end
        if at + PIECE < end:
            gaps = np.flatnonzero(~NOT_SPACE[data[at:at + PIECE]])
            to = at + int(gaps[-1]) + 1 if len(gaps) else _forward(data, at + PIECE, end, False)
            seen = max(_forward(data, _forward(data, to, end, True), end, False), min(to + 4, end))
        yield at, to, seen
        at = to


def _grams(data: np.ndarray, off: np.ndarray):
    """(first row, [(positions' start offsets per row, buckets)] by kind) for runs of rows; a gram lies in one row.

    A text longer than a piece comes as several runs with one row, each with the grams that start in it."""
    for a, b in pieces(off, PIECE):
        if off[b] - off[a] <= PIECE:
            yield a, b, _kinds(data[off[a]:off[b]], off[a:b + 1] - off[a])
            continue
        for at, to, seen in _cuts(data, int(off[a]), int(off[b])):
            yield a, b, _kinds(data[at:seen], np.array([0, seen - at]), to - at)


def _kinds(raw: np.ndarray, o: np.ndarray, upto: int | None = None):
    upto, out = len(raw) if upto is None else upto, []
    wide = np.zeros(len(raw), np.uint64)
    for i in range(5):
        wide[:len(raw) - i] |= raw[i:].astype(np.uint64) << np.uint64(8 * i)
    bucket = ((wide + np.uint64(1)) * _ODD >> _TOP).astype(np.int64)
    ok = np.ones(len(raw), bool)
    for i in range(1, 5):
        ends = o[1:] - i
        ok[ends[ends >= o[:-1]]] = False
    ok[upto:] = False
    out.append((o, bucket, ok))
    low = LOWER[raw]
    start, end = word_spans(low, o[1:], NOT_SPACE)
    h = span_hashes(low, start, end) if len(start) else np.zeros(0, np.uint64)
    w = np.searchsorted(start, o)
    here = start < upto
    out.append((w, (h >> _TOP).astype(np.int64), here))
    pair = h.copy()
    if len(h) > 1:
        pair[:-1] = np.where(h[:-1] == h[1:], _PAIR_OF_EQUALS, mix(h[:-1] * np.uint64(3) + h[1:]))
    ok = here.copy()
    last = w[1:][w[1:] > w[:-1]] - 1
    ok[last] = False
    out.append((w, (pair >> _TOP).astype(np.int64), ok))
    return out


def _row_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[off[1:]] - total[off[:-1]]


def fit(docs: DataFrame, good: DataFrame) -> np.ndarray:
    """log(p_target / p_raw) by kind and bucket, from all of ``docs(doc_id, text)`` and the ids in ``good(doc_id)``."""
    spark = docs.sparkSession
    ids = (good.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_DOCS).collect())
    if not ids:
        return np.zeros((KINDS, _SIZE))
    shared = spark.sparkContext.broadcast(np.sort(np.array([r.doc_id for r in ids], np.int64)))

    def count(batches):
        total = np.zeros((2, KINDS, _SIZE), np.int64)
        for batch in batches:
            doc = batch.column(0).fill_null(-1 << 62).to_numpy()
            target = np.isin(doc, shared.value)
            data, off = column_bytes(batch.column(1))
            for a, b, kinds in _grams(data, off):
                for k, (o, bucket, ok) in enumerate(kinds):
                    total[0, k] += np.bincount(bucket[ok], minlength=_SIZE)
                    if target[a:b].any():
                        hit = ok & np.repeat(target[a:b], np.diff(o))
                        total[1, k] += np.bincount(bucket[hit], minlength=_SIZE)
        give_back()
        raw, good_ = total.reshape(2, -1)
        at = np.flatnonzero(raw)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good_[at])], names=["bucket", "raw", "target"])

    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "bucket long, raw long, target long")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect())  # KINDS x 2^BITS rows at most
    shared.destroy()
    n = np.ones((2, KINDS * _SIZE))
    for r in rows:
        n[0, r.bucket] += r.raw
        n[1, r.bucket] += r.target
    n = n.reshape(2, KINDS, _SIZE)
    p = n / n.sum(2, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def with_keys(docs: DataFrame, ratio: np.ndarray, seed: int = 9) -> DataFrame:
    """``docs`` with __log_weight and __key (the weight plus the row's Gumbel noise)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    names = docs.columns
    text_at = names.index("text")

    def score(batches):
        for batch in batches:
            data, off = column_bytes(batch.column(text_at))
            s = np.zeros(batch.num_rows)
            for a, b, kinds in _grams(data, off):
                for k, (o, bucket, ok) in enumerate(kinds):
                    s[a:b] += _row_sums(np.where(ok, shared.value[k][bucket], 0.0), o)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(s, 6))], names=[*names, "__log_weight"])
        give_back()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", `__log_weight` double"
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11) + 0.5) / F.lit(float(1 << 53))
    return docs.mapInArrow(score, schema).withColumn("__key", F.col("__log_weight") - F.log(-F.log(u)))


def kth_largest(values: DataFrame, k: int) -> float:
    """The k-th largest of ``values(v)`` (1: the largest), by counts in finer and finer bins."""
    lo, hi = values.agg(F.min("v"), F.max("v")).first()
    while True:
        if lo == hi:
            return lo
        inside = values.filter((F.col("v") >= lo) & (F.col("v") <= hi))
        bin_ = F.least(F.floor((F.col("v") - lo) / F.lit(hi - lo) * _BINS), F.lit(_BINS - 1))
        rows = inside.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r.b):
            if k <= r.n:
                break
            k -= r.n
        lo, hi = r.lo, r.hi
        if r.n <= _FEW:
            few = values.filter((F.col("v") >= lo) & (F.col("v") <= hi)).collect()  # at most _FEW rows
            return sorted((x.v for x in few), reverse=True)[k - 1]


def best_cut(keys: DataFrame) -> float | None:
    """The cut c with the fewest errors on ``keys(v, good)`` (weights), found in bins that are made finer around the best edge: a
    row is selected if v >= c. Among equals the least; None (all rows) if no cut does better."""
    keys = keys.filter("v is not null")
    lo, hi, n_bad = keys.agg(F.min("v"), F.max("v"), F.sum((~F.col("good")).cast("long"))).first()
    best, least = None, n_bad or 0
    below_good, below_bad = 0, 0
    while lo is not None and lo < hi:
        bin_ = F.least(F.floor((F.col("v") - lo) / F.lit(hi - lo) * _BINS), F.lit(_BINS - 1))
        rows = sorted(keys.filter((F.col("v") >= lo) & (F.col("v") <= hi)).groupBy(bin_.alias("b")).agg(
            F.sum(F.col("good").cast("long")).alias("g"), F.sum((~F.col("good")).cast("long")).alias("x"), F.min("v").alias("lo"),
            F.max("v").alias("hi")).collect(), key=lambda r: r.b)  # at most _BINS rows
        good, bad, at, before = below_good, below_bad, None, [(below_good, below_bad)]
        for i, r in enumerate(rows):
            if i and good + n_bad - bad < least:  # the edge lies amid the gap: labelled good texts weigh more than others
                best, least, at = (rows[i - 1].hi + r.lo) / 2, good + n_bad - bad, i
            good, bad = good + r.g, bad + r.x
            before.append((good, bad))
        if at is None or (rows[at - 1].lo, rows[at].hi) == (lo, hi):
            break
        (below_good, below_bad), lo, hi = before[at - 1], rows[at - 1].lo, rows[at].hi
    return best


def learned_cut(weights: DataFrame, labels: DataFrame) -> float | None:
    """:func:`best_cut` of the labelled documents' ``weights(doc_id, v)`` (None: no good label, all rows stay)."""
    quality = (labels.filter("doc_id is not null and quality is not null")
               .select(F.col("doc_id").alias("__id"), (F.col("quality") == 1).alias("good")).distinct())
    found = weights.select("doc_id", "v").distinct()  # equal rows count once
    found = stored(found.join(quality, F.col("doc_id") == F.col("__id")).select("v", "good"), "labelled")
    return best_cut(found) if found.filter("good").limit(1).count() else None


def select_quality(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """``docs`` with __log_weight, __key and __selected: the k rows with the largest keys, where k is a ``share`` of the
    rows or (None) the number of rows whose weight is over the labelled documents' best cut.

    Texts are scored in the scan and never shuffled: the labels meet (id, weight) pairs. Columns of ``docs`` with the
    result's names are replaced."""
    docs = docs.drop("__log_weight", "__key", "__selected")
    ratio = fit(docs, labels.filter("quality = 1").select("doc_id"))
    slim = stored(with_keys(docs.select("doc_id", "text"), ratio).select("doc_id", "__log_weight", "__key"), "keys")
    if share is None:
        cut = learned_cut(slim.select("doc_id", F.col("__log_weight").alias("v")), labels)
        k = None if cut is None else slim.filter(F.col("__log_weight") >= cut).count()
    else:
        n = slim.count()
        k = min(n, max(1, round(share * n))) if n else None
    least = kth_largest(slim.select(F.col("__key").alias("v")), k) if k else None
    selected = F.lit(k is None) if least is None else F.col("__key") >= F.lit(least)
    return with_keys(docs, ratio).withColumn("__selected", selected)
