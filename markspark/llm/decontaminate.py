"""Operator 3: benchmark decontamination as a prefix-filtered set join.

Every benchmark item gives *probes*: runs of ``window`` consecutive words (or
the whole item where it has fewer). A probe is the set of its word shingles.
The shingles are ordered by rarity over all documents; with a containment
threshold t a document window can only reach t if it holds one of the
``m - ceil(t*m) + 1`` rarest shingles of a probe's m, so only those are joined
with the documents' shingles. A hit fixes where the item-sized window can
start (positional bound) and it must lie inside the text (length bound); the
survivors are verified on all their words (t = 1) or on the number of distinct
shingles inside the window (t < 1).

The join side that grows, the documents, is scanned and never shuffled. The
benchmark is taken in hash blocks of about ``PAIRS_PER_BLOCK`` (probe, item)
pairs; one block's tables are broadcast at a time, so the broadcast's size is
bounded for any benchmark and every block is joined with every document.

Defined results: a null text, or one without words, has no words and no hits;
items without words, and items with a null id, take no part; items repeated
under one id count once; equal texts under different ids count each; documents
repeated row by row are returned row by row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markspark.llm.common import giving_back, hashed_blocks, stored
from markspark.llm.words import ALNUM, column_bytes, row_words, shingles

PAIRS_PER_BLOCK = 50_000
#: (probe, item) pairs in one broadcast block: about 10 MB of tables.
PAIRS_PER_BLOCK = 50_000
_TABLE_BITS = 20


def _item_probes(items: DataFrame, window: int, min_words: int) -> DataFrame:
    """(item, probe): distinct probes of every item, as the words' hashes."""
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, off, h in row_words(batch.column(1), ALNUM):
                out_id, out = [], []
                for r in range(len(off) - 1):
                    w = h[off[r]:off[r + 1]]
                    if len(w) < min_words:
                        continue
                    size = min(window, len(w))
                    found = {w[i:i + size].tobytes() for i in range(len(w) - size + 1)}
                    out_id += [ids[first + r].as_py()] * len(found)
                    out += found
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.string()), pa.array(out, pa.binary())],
                                                     names=["item", "probe"])

    src = items.select(F.col("item_id").cast("string").alias("item"), "text").filter("item is not null")
    return src.mapInArrow(giving_back(probe), "item string, probe binary").distinct()


class _Block:
    """One block of probes, as flat arrays."""

    def __init__(self, rows, shingle: int, threshold: float):
        by: dict[bytes, list[str]] = {}
        for item, probe in rows:
            by.setdefault(bytes(probe), []).append(item)
        self.words = [np.frombuffer(p, np.uint64) for p in by]
        self.items = list(by.values())
        self.threshold = threshold
        self.k = [min(shingle, len(w)) for w in self.words]
        self.sets = [shingles(w, k) for w, k in zip(self.words, self.k, strict=True)]
        self.tokens = {k: np.unique(np.concatenate([s for s, kk in zip(self.sets, self.k, strict=True) if kk == k]))
                       for k in set(self.k)}
        self.prefix: dict[int, tuple] = {}

    def order(self, seen: dict[int, dict[int, int]]) -> None:
        """Keep each probe's rarest shingles, as a table token -> (probe, offset)."""
        rows: dict[int, list[tuple[int, int, int]]] = {k: [] for k in self.tokens}
        for p, (s, k) in enumerate(zip(self.sets, self.k, strict=True)):
            distinct = sorted({int(x) for x in s}, key=lambda x: (seen[k].get(x, 0), x))
            keep = set(distinct[:len(distinct) - math.ceil(self.threshold * len(distinct)) + 1])
            if self.threshold >= 1:  # one place of the rarest shingle is enough to find the start
                rows[k].append((distinct[0], p, int(np.flatnonzero(s == np.uint64(distinct[0]))[0])))
            else:
                rows[k] += [(int(x), p, i) for i, x in enumerate(s) if int(x) in keep]
        for k, found in rows.items():
            found.sort()
            tok = np.array([r[0] for r in found], np.uint64)
            self.prefix[k] = (*np.unique(tok, return_index=True), np.array([r[1] for r in found]),
                              np.array([r[2] for r in found]), len(found))


def _sieve(tokens: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << _TABLE_BITS, bool)
    table[(tokens >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
    return table


def _find(sorted_tokens, sieve, h) -> tuple[np.ndarray, np.ndarray]:
    """Positions in h whose token is in the sorted table, and where it is."""
    at = np.flatnonzero(sieve[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
    where = np.minimum(np.searchsorted(sorted_tokens, h[at]), len(sorted_tokens) - 1)
    ok = sorted_tokens[where] == h[at]
    return at[ok], where[ok]


def _rarity(docs: DataFrame, tokens: dict[int, np.ndarray]) -> dict[int, dict[int, int]]:
    """How often each benchmark shingle of one block stands in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(tokens)

    def count(batches):
        toks = shared.value
        total = {k: np.zeros(len(t), np.int64) for k, t in toks.items()}
        sieve = {k: _sieve(t) for k, t in toks.items()}
        for batch in batches:
            for _, off, h in row_words(batch.column(0), ALNUM):
                for k, t in toks.items():
                    at, where = _find(t, sieve[k], shingles(h, k))
                    row = np.searchsorted(off, at, side="right")
                    np.add.at(total[k], where[at + k <= off[np.minimum(row, len(off) - 1)]], 1)
        for k, n in total.items():
            at = np.flatnonzero(n)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(n[at])],
                                                 names=["k", "token", "n"])

    rows = docs.select("text").mapInArrow(giving_back(count), "k long, token long, n long").groupBy("k", "token").agg(F.sum("n").alias("n"))
    out: dict[int, dict[int, int]] = {k: {} for k in tokens}
    for r in rows.collect():  # at most one row for each shingle of the block
        out[r.k][int(tokens[r.k][r.token])] = r.n
    shared.destroy()
    return out


def _verify_exact(block: _Block, h, lo, hi, p, start):
    w = block.words[p]
    return lo <= start and start + len(w) <= hi and np.array_equal(h[start:start + len(w)], w)


def _windows(block: _Block, p: int, h, lo, hi, at: int, memo: dict):
    """Item-sized windows of words [lo, hi) around position ``at`` that hold the threshold's share of probe p."""
    k, w, s = block.k[p], block.words[p], block.sets[p]
    span = len(w) - k + 1
    need = math.ceil(block.threshold * len(set(s.tolist())))
    for start in range(max(lo, at - span + 1), min(at, hi - len(w)) + 1):
        if (p, start) not in memo:
            memo[p, start] = len(np.intersect1d(shingles(h[start:start + len(w)], k), s)) >= need
        if memo[p, start]:
            yield start


def _matches(block: _Block, h, off) -> Iterator[tuple[int, int, int, int]]:
    """(row, probe, first word, last word + 1), words counted inside the row."""
    for k, (toks, first, probe, offset, n) in block.prefix.items():
        at, where = _find(toks, block.sieve[k], shingles(h, k))
        if not len(at):
            continue
        rows = np.searchsorted(off, at, side="right") - 1
        bounds = np.append(first, n)
        memo: dict = {}
        for pos, t, r in zip(at.tolist(), where.tolist(), rows.tolist(), strict=True):
            lo, hi = int(off[r]), int(off[r + 1])
            for j in range(bounds[t], bounds[t + 1]):
                p = int(probe[j])
                if block.threshold >= 1:
                    start = pos - int(offset[j])
                    starts = [start] if _verify_exact(block, h, lo, hi, p, start) else []
                else:
                    starts = _windows(block, p, h, lo, hi, pos, memo)
                for start in starts:
                    yield r, p, start - lo, start - lo + len(block.words[p])


def _blocks(probes: DataFrame, pairs_per_block: int, shingle: int, threshold: float) -> Iterator[_Block]:
    pairs = stored(probes, "probes")
    n = hashed_blocks(pairs.count(), pairs_per_block)
    for i in range(n):
        rows = pairs.filter(F.pmod(F.xxhash64("item", "probe"), F.lit(n)) == i).collect()  # about pairs_per_block rows
        if rows:
            yield _Block(rows, shingle, threshold)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_HITS = "doc_id long, th long, spans array<struct<a:long,b:long>>, items array<string>"


def _hits(docs: DataFrame, block: _Block) -> DataFrame:
    """Documents with occurrences of the block's probes: merged word spans and item ids."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def scan(batches):
        b = shared.value
        b.sieve = {k: _sieve(v[0]) for k, v in b.prefix.items()}
        for batch in batches:
            ids, ths, spans, items = [], [], [], []
            doc, th = batch.column(0), batch.column(1)
            for first, off, h in row_words(batch.column(2), ALNUM):
                found: dict[int, tuple[list, set]] = {}
                for r, p, x, y in _matches(b, h, off):
                    own = found.setdefault(first + r, ([], set()))
                    own[0].append((x, y))
                    own[1].update(b.items[p])
                for r, (s, i) in found.items():
                    ids.append(doc[r].as_py())
                    ths.append(th[r].as_py())
                    spans.append([{"a": x, "b": y} for x, y in _merge(s)])
                    items.append(sorted(i))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(ths, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                     pa.array(items, pa.list_(pa.string()))], names=["doc_id", "th", "spans", "items"])

    return docs.select("doc_id", "th", "text").mapInArrow(giving_back(scan), _HITS)


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, threshold: float = 1.0,
                  min_words: int = 1, pairs_per_block: int = PAIRS_PER_BLOCK) -> DataFrame:
    """One row per document row: (doc_id, th, n_words, spans, items).

    ``spans``: disjoint [a, b) runs of words covered by an occurrence of a
    probe; ``items``: ids of items with occurrences. ``th`` is a hash of the
    text. Items of fewer than ``min_words`` words take no part. Both tables
    need doc_id/item_id and text; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("th", F.xxhash64("text"))
    hits = None
    for block in _blocks(_item_probes(items, window, min_words), pairs_per_block, shingle, threshold):
        block.order(_rarity(docs, block.tokens))
        found = _hits(docs, block)
        hits = found if hits is None else hits.unionByName(found)

    def count(batches):
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            for first, off, _ in row_words(batch.column(2), ALNUM):
                n_words[first:first + len(off) - 1] = np.diff(off)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words)],
                                             names=["doc_id", "th", "n_words"])

    base = docs.select("doc_id", "th", "text").mapInArrow(giving_back(count), "doc_id long, th long, n_words long")
    none = "array<struct<a:long,b:long>>"
    if hits is None:
        return base.select("*", F.expr(f"cast(array() as {none})").alias("spans"),
                           F.expr("cast(array() as array<string>)").alias("items"))
    hits = (hits.groupBy("doc_id", "th").agg(F.collect_set("spans").alias("s"), F.collect_set("items").alias("i"))
            .select(F.col("doc_id").alias("hd"), F.col("th").alias("hth"),
                    F.array_sort(F.flatten("s")).alias("spans"), F.array_sort(F.array_distinct(F.flatten("i"))).alias("items")))
    on = base.doc_id.eqNullSafe(hits.hd) & (base.th == hits.hth)
    return (base.join(hits, on, "left")
            .select("doc_id", "th", "n_words", F.coalesce("spans", F.expr(f"cast(array() as {none})")).alias("spans"),
                    F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")))


def covered(spans: str = "spans"):
    """Words in the union of sorted [a, b) spans (spans of different blocks may overlap)."""
    return F.expr(f"""aggregate({spans}, named_struct('n', 0L, 'to', 0L),
        (s, x) -> named_struct('n', s.n + greatest(0L, x.b - greatest(x.a, s.to)), 'to', greatest(s.to, x.b)), s -> s.n)""")


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, threshold: float = 1.0,
                        min_words: int = 5, pairs_per_block: int = PAIRS_PER_BLOCK) -> DataFrame:
    """``docs`` without the rows in which a probe occurs, all columns kept: each block is one more
    filter in the scan, without a shuffle of the texts."""
    blocks = _blocks(_item_probes(items, window, min_words), pairs_per_block, shingle, threshold)
    text_at, out = docs.columns.index("text"), docs
    for block in blocks:
        block.order(_rarity(docs.select("text"), block.tokens))
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches, shared=shared):
            b = shared.value
            b.sieve = {k: _sieve(v[0]) for k, v in b.prefix.items()}
            for batch in batches:
                hit = np.zeros(batch.num_rows, bool)
                for first, off, h in row_words(batch.column(text_at), ALNUM):
                    for r, *_ in _matches(b, h, off):
                        hit[first + r] = True
                yield batch.filter(pa.array(~hit))
            b.sieve = None

        out = out.mapInArrow(giving_back(clean), docs.schema)
    return out
