"""Operator 7: near-duplicate groups with a MinHash LSH forest.

1. Sets. A text's distinct k-word shingles are hashed; equal sets (exact and
   re-spaced copies) collapse to one row, keyed by a 128-bit digest.
2. Forest. A signature of minima gives ``TREES`` sorted orders, each starting
   with its own ``DEPTH`` minima and going on with further ones. The orders
   are sorted across the cluster (a huge region spreads over many tasks) and
   every set is linked to the next one in each order if their common prefix
   is long. These links only gather sets into families.
3. Regions. Sets that agree on a tree's first ``DEPTH`` minima share a region.
   Regions that still hold several families are compared across families, in
   blocks of bounded size (deeper regions of one family need no further look),
   and join families whose estimated similarity is not clearly too low: four
   standard errors under the threshold. So any two sets of one region that
   could be linked end in one family.
4. Links. Within a family, full sets are compared in blocks x blocks of
   bounded bytes, and every link found by exact intersection is kept unless
   its two ends are connected already in that block pair.
5. Components of those links.

A pair at a similarity of exactly 0.85 shares no region in any tree with a
probability of 4e-7 (0.8: 3e-5), and the estimate loses it with 3e-5.

Defined results: documents without words (or with null text) have empty sets
and form components of their own; texts of fewer than k words have the whole
sequence as their one shingle; a repeated doc_id keeps one row for each of
its rows; a null doc_id never names a component that has other ids.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markspark.llm.common import giving_back, stored
from markspark.llm.components import Forest, components
from markspark.llm.words import NOT_SPACE, mix, row_words, shingles

TREES, DEPTH, MINIMA = 20, 4, 128
#: Further minima (one byte each) that sort a region.
ORDER = 8
#: Links with a common prefix this long make families at once; shorter ones wait for step 3.
FAMILY_PREFIX = 8
#: Sets, and bytes of sets, in one block of a comparison.
BLOCK_SETS, BLOCK_BYTES = 256, 16 << 20

_RNG = np.random.default_rng(77)
_MUL = (_RNG.integers(0, 1 << 31, MINIMA, dtype=np.uint32) << 1) | 1
_XOR = _RNG.integers(0, 1 << 32, MINIMA, dtype=np.uint32)


_COLUMNS = 512


def signature(s: np.ndarray) -> np.ndarray:
    """Minima of the set under ``MINIMA`` hash orders."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    work = np.empty((min(_COLUMNS, len(low)), MINIMA), np.uint32)
    best = np.full(MINIMA, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), _COLUMNS):
        x = low[at:at + _COLUMNS, None]
        part = work[:len(x)]
        np.multiply(x, _MUL, out=part)
        np.bitwise_xor(part, _XOR, out=part)
        np.minimum(best, part.min(0), out=best)
    return best


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def _sets(texts, k: int):
    """The sorted shingle set of every text, in order (empty without words; one shingle below k words)."""
    for _, off, h in row_words(texts, NOT_SPACE):
        runs = shingles(h, k)
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            yield _distinct(runs[a:b - k + 1]) if b - a >= k else shingles(h[a:b], max(1, b - a))


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _signed(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, th, n, id, sig) of docs(doc_id, th, text): set size, digest and signature bytes of every document.

    sig: for each tree 8 bytes of region key and ORDER of the order below it, then one byte of every minimum."""
    def run(batches):
        for batch in batches:
            n, ids, sigs = [], [], []
            for s in _sets(batch.column(2), k):
                n.append(len(s))
                ids.append(_digest(s) if len(s) else None)
                sigs.append(_signature_bytes(signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()),
                                              pa.array(ids, pa.binary()), pa.array(sigs, pa.binary())],
                                             names=["doc_id", "th", "n", "id", "sig"])

    return docs.select("doc_id", "th", "text").mapInArrow(giving_back(run), "doc_id long, th long, n long, id binary, sig binary")


_BELOW = (np.arange(1, TREES + 1)[:, None] * DEPTH + np.arange(ORDER)[None]) % MINIMA


def _signature_bytes(m: np.ndarray) -> bytes:
    low = (m & np.uint32(0xFF)).astype(np.uint8)
    key = _region_keys(m[:TREES * DEPTH].reshape(TREES, DEPTH).astype(np.uint64))
    return np.concatenate([key.view(np.uint8).reshape(TREES, 8), low[_BELOW]], axis=1).tobytes() + low.tobytes()


def _region_keys(m: np.ndarray) -> np.ndarray:
    """64-bit region key of each row of minima."""
    h = np.zeros(len(m), np.uint64)
    for i in range(m.shape[1]):
        h = mix(h ^ m[:, i])
    return h


def _crowded(sets: DataFrame) -> DataFrame:
    """(tree, key, id, near): members of regions with two sets or more, from one sort of all orders.

    ``near`` is the neighbour in the sorted order if both share FAMILY_PREFIX minima. A region
    that meets the edge of a sorted partition is kept whatever its size, as the rest may lie next door."""
    extra = FAMILY_PREFIX - DEPTH

    def batch_of(rows):
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary()),
                                           pa.array(cols[3], pa.binary())], names=["tree", "key", "id", "near"])

    def run(batches):
        out, last, alone, edge = [], None, None, True  # alone: a row that waits for a second one of its region
        for batch in batches:
            for tree, key, below, one in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                same = last is not None and last[0] == tree and last[1] == key
                if not same:
                    edge = last is None
                    if alone and alone[1]:
                        out.append(alone[0])
                    alone = ((tree, key, one, None), edge)
                else:
                    if alone:
                        out.append(alone[0])
                        alone = None
                    close = last[2][:extra] == below[:extra] and last[3] != one
                    out.append((tree, key, one, last[3] if close else None))
                last = (tree, key, below, one)
            if len(out) > 20_000:
                yield batch_of(out)
                out = []
        if alone:
            out.append(alone[0])
        if out:
            yield batch_of(out)

    t = sets.select(F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "id", "sig")
    at = f"1 + tree * {8 + ORDER}"
    orders = t.select("tree", F.expr(f"substring(sig, {at}, 8)").alias("key"), F.expr(f"substring(sig, {at} + 8, {ORDER})").alias("below"), "id")
    return (orders.repartitionByRange("tree", "key", "below", "id").sortWithinPartitions("tree", "key", "below", "id")
            .mapInArrow(giving_back(run), "tree int, key binary, id binary, near binary"))


def _est():
    return F.expr(f"substring(sig, {1 + (8 + ORDER) * TREES}, {MINIMA})")


def _block_pairs(rows: DataFrame, blocks) -> DataFrame:
    """Every row of a group sent to the pairs (lo, hi) of its block with each block of the group."""
    return (rows.withColumn("nb", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb")))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
            .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
            .drop("nb", "other"))


def _grouped(batches, n_keys: int):
    """Consecutive rows with equal first n_keys columns, as column lists."""
    held, key = None, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:n_keys] != key:
                if held:
                    yield key, held
                key, held = row[:n_keys], []
            held.append(row[n_keys:])
    if held:
        yield key, held


def _region_links(crowded: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links between families that share a region and whose signatures agree on a share of ``least`` or more."""
    need = least * MINIMA

    def run(batches):
        for _, rows in _grouped(batches, 4):
            ids, fams, own = [r[0] for r in rows], [r[1] for r in rows], np.array([r[3] for r in rows])
            code = {f: i for i, f in enumerate(dict.fromkeys(fams))}
            if len(code) < 2:
                continue
            fam = np.array([code[f] for f in fams])
            sig = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)
            counts = np.bincount(fam)
            order = np.argsort(counts[fam], kind="stable")  # rows of small families first: the largest meets only the others
            forest, names, found = Forest(), list(code), []
            for pos, i in enumerate(order):
                if pos and counts[fam[i]] == len(rows):
                    break
                rest = order[pos + 1:]
                rest = rest[fam[rest] != fam[i]]
                if not len(rest):
                    continue
                rest = rest[(sig[rest] == sig[i]).sum(1) >= need]
                for j in rest.tolist():
                    if forest.join(names[fam[i]], names[fam[j]]):
                        found.append((names[fam[i]], names[fam[j]]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()),
                                                  pa.array([y for _, y in found], pa.binary())], names=["a", "b"])

    region = crowded.select("tree", "key", "id").join(sets.select("id", "fam"), "id")
    mixed = (region.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("members"), F.min("fam").alias("f0"), F.max("fam").alias("f1"))
             .filter("f0 <> f1").select("tree", "key", "members"))
    members = (region.join(mixed, ["tree", "key"])
               .join(sets.select("id", _est().alias("est")), "id"))
    spread = _block_pairs(members, F.ceil(F.col("members") / BLOCK_SETS).cast("long"))
    return (spread.select("tree", "key", "lo", "hi", "id", "fam", "est", "own")
            .repartition("tree", "key", "lo", "hi").sortWithinPartitions("tree", "key", "lo", "hi")
            .mapInArrow(giving_back(run), "a binary, b binary"))


def _exact_links(docs: DataFrame, sets: DataFrame, k: int, percent: int, least: float) -> DataFrame:
    """Verified links inside families: a spanning part of them for each pair of blocks."""
    fams = sets.groupBy("fam").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("size")).filter("members > 1")
    rows = sets.join(fams, "fam").select(
        "fam", "id", _est().alias("est"), F.col("rep").alias("doc_id"), "th",
        F.ceil(F.greatest(F.col("members") / BLOCK_SETS, F.col("size") * 8 / BLOCK_BYTES)).cast("long").alias("nb"))

    def full(batches):
        for batch in batches:
            items = [s.tobytes() for s in _sets(batch.column(4), k)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(items, pa.binary())],
                                             names=["fam", "id", "est", "nb", "items"])

    texts = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), "text").join(
        rows, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th")))
    one = texts.select("fam", "id", "est", "nb", "text").dropDuplicates(["id"])
    items = one.mapInArrow(giving_back(full), "fam binary, id binary, est binary, nb long, items binary")
    spread = _block_pairs(items, F.col("nb"))
    need = least * MINIMA

    def run(batches):
        for (_, lo, hi), rows in _grouped(batches, 3):
            rows.sort(key=lambda r: r[0])
            sets_ = [np.frombuffer(r[2], np.uint64) for r in rows]
            size = np.array([len(s) for s in sets_])
            sig = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), -1)
            own = np.array([r[3] for r in rows])
            forest = Forest()
            for i in range(len(rows) - 1):
                rest = np.arange(i + 1, len(rows))
                if lo != hi:
                    rest = rest[own[rest] != own[i]]
                small, large = np.minimum(size[rest], size[i]), np.maximum(size[rest], size[i])
                rest = rest[100 * small >= percent * large]
                agree = (sig[rest] == sig[i]).sum(1)
                rest, agree = rest[agree >= need], agree[agree >= need]
                for j in rest[np.argsort(-agree, kind="stable")].tolist():
                    if forest.root(i) == forest.root(j):
                        continue
                    both = len(np.intersect1d(sets_[i], sets_[j], assume_unique=True))
                    if 100 * both >= percent * (size[i] + size[j] - both):
                        forest.join(i, j)
            links = forest.links()
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([rows[x][0] for x, _ in links], pa.binary()),
                                                  pa.array([rows[y][0] for _, y in links], pa.binary())], names=["a", "b"])

    return (spread.select("fam", "lo", "hi", "id", "est", "items", "own").repartition("fam", "lo", "hi")
            .sortWithinPartitions("fam", "lo", "hi").mapInArrow(giving_back(run), "a binary, b binary"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, group_id) for every row of ``docs(doc_id, text)``.

    th is a hash of the text, group_id names the component by its sets (null without words).

    Sets with 100 * intersection >= percent * union are linked; component_id
    is the smallest doc_id that can be reached over links."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    share = percent / 100
    least = share - 4 * math.sqrt(share * (1 - share) / MINIMA)
    signed = stored(_signed(docs.withColumn("th", F.xxhash64("text")), k), "signed")
    rows = signed.select("doc_id", "th", "n", "id")
    sets = signed.filter("id is not null").groupBy("id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("rep"), "th")).alias("r"),
        F.first("n").alias("n"), F.first("sig").alias("sig"))
    sets = stored(sets.select("id", "r.rep", "r.th", "n", "sig"), "sets")

    crowded = stored(_crowded(sets), "crowded")
    fam = components(crowded.filter("near is not null").select(F.col("id").alias("a"), F.col("near").alias("b")))
    first = sets.join(fam, sets.id == fam.u, "left").select(sets["*"], F.coalesce("root", "id").alias("fam"))
    joined = components(_region_links(crowded, first, least)).select(F.col("u").alias("f"), F.col("root").alias("g"))
    second = first.join(joined, F.col("fam") == F.col("f"), "left").withColumn("fam", F.coalesce("g", "fam")).drop("f", "g")
    comp = components(_exact_links(docs, second, k, percent, least))

    of_set = (sets.select("id", "rep").join(comp, F.col("id") == F.col("u"), "left")
              .select("id", "rep", F.coalesce("root", "id").alias("group_id")))
    name = of_set.groupBy("group_id").agg(F.min("rep").alias("component_id"))
    named = of_set.join(name, "group_id").select("id", "component_id", "group_id")
    full = rows.filter("id is not null").join(named, "id").select("doc_id", "th", F.col("n").alias("n_shingles"), "component_id", "group_id")
    empty = rows.filter("id is null").select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"),
                                             F.lit(None).cast("binary").alias("group_id"))
    return full.unionByName(empty)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of every near-duplicate group (smallest doc_id, nulls last); rows without words all stay."""
    found = near_duplicates(docs, k, percent)
    none = F.lit(-1 << 63).cast("long")  # stands for a null id in the join below
    first = (found.filter("group_id is not null").groupBy("group_id")
             .agg(F.min(F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", none).alias("k"), "th")).alias("f"))
             .select(F.col("f.k").alias("__near_id"), F.col("f.th").alias("__near_th")))
    keys = first.withColumn("__near_one", F.lit(True)).unionByName(
        found.filter("group_id is null").select(F.coalesce("doc_id", none).alias("__near_id"), F.col("th").alias("__near_th"),
                                                F.lit(False).alias("__near_one")).distinct())
    own = docs.withColumn("__near_k", F.coalesce(F.col("doc_id").cast("long"), none)).withColumn("__near_h", F.xxhash64("text"))
    kept = own.join(keys, (F.col("__near_k") == F.col("__near_id")) & (F.col("__near_h") == F.col("__near_th")))
    # a kept row may stand in the table several times; equal keys are in one place already
    single = kept.filter("__near_one").dropDuplicates(["__near_k", "__near_h"])
    return single.unionByName(kept.filter("not __near_one")).select(*docs.columns)
