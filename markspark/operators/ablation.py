"""Ablation of a text classifier over input variants, all fitted together.

A variant is an order of some of the input's segments: all of them, one left
out, one alone, or an order shuffled by row. Tokens are hashed once per
segment; a variant's row only picks the hashes of its segments. A token counts
as a word and as a word at its segment's place, so that the order of the
segments is part of the input. Rows of all variants lie in one table with the
variant's number, and every step of the fit sums the gradients of all variants
in one job: a step costs what a step of a single fit over as many rows costs.

Features are term frequency times inverse document frequency in ``buckets``
hashed buckets, each row scaled to length one. The classifier is a logistic
regression with a squared penalty, fitted by L-BFGS; as the loss is strictly
convex, the fit does not depend on the steps taken. The driver holds weights
of variants x buckets, as Spark's own linear models do, and no rows.

Defined results: a null segment is an empty one; a row without tokens is
scored by the intercept; rows without a label are scored, not learnt from;
with no training rows all weights stay 0 and every probability is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspark.functions.numeric import md5_unit
from markspark.functions.text import tokens
from markspark.session import materialize

#: Corrections that L-BFGS remembers.
MEMORY = 6
#: Terms in a block of scaled rows, numbers in a part of a gradient.
_TERMS, _PART = 1 << 18, 1 << 15


def fixed_order(*segments: int) -> Column:
    """The same segments in the same order for every row."""
    return F.array(*[F.lit(s) for s in segments])


def shuffled_order(key: str, n: int, seed: int = 42) -> Column:
    """All ``n`` segments in an order of the row's own, the same on every run."""
    drawn = F.array_sort(F.array(*[F.struct(md5_unit(F.lit(seed), F.col(key), F.lit(i), digits=15).alias("r"), F.lit(i).alias("i"))
                                   for i in range(n)]))
    return F.transform(drawn, lambda x: x["i"])


def variant_rows(df: DataFrame, key: str, label: str, segments: list[Column], variants: dict[str, Column], buckets: int,
                 test: Column) -> DataFrame:
    """(<key>, label, test, variant, idx, tf), stored: every row of ``df`` once for each variant, numbered in the order
    of ``variants``, with the distinct buckets of its tokens and how often each occurs."""
    hashed = F.array(*[F.transform(tokens(F.lower(F.coalesce(s, F.lit("")))), lambda t: F.xxhash64(t)) for s in segments])
    each = F.array(*[F.struct(F.lit(i).alias("variant"), order.alias("_order")) for i, order in enumerate(variants.values())])
    d = df.select(F.col(key), F.col(label).cast("double").alias("label"), F.coalesce(test, F.lit(False)).alias("test"),
                  hashed.alias("_hash"), F.explode(each).alias("_v"))

    def placed(segment, place):
        return F.flatten(F.transform(F.element_at("_hash", segment + 1), lambda h: F.array(
            F.pmod(h, F.lit(buckets)).cast("int"), F.pmod(F.xxhash64(h, place), F.lit(buckets)).cast("int"))))

    d = d.select(key, "label", "test", F.col("_v.variant").alias("variant"), F.flatten(F.transform("_v._order", placed)).alias("idx"))

    def counted(batches):
        for b in batches:
            idx, tf = [], []
            for x in b.column(4):
                u, n = np.unique(np.asarray(x.values, dtype=np.int32), return_counts=True)
                idx.append(u)
                tf.append(n.astype(np.float32))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(idx, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.float32()))],
                                             names=[*b.schema.names[:4], "idx", "tf"])

    kind = df.select(key).schema[0].dataType.simpleString()
    return materialize(d.mapInArrow(counted, f"`{key}` {kind}, label double, test boolean, variant int, idx array<int>, tf array<float>"))


@dataclass
class Fit:
    """Weights, intercepts and inverse document frequencies of all variants, in their order."""
    names: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    evaluations: int = 0


def _margins():
    """A function giving (row of every term, flat feature, scaled value, margin of every row); made here, as what a
    function makes is sent to the workers whole and needs no package there."""
    def margins(variant, idx, tf, weights, bias, idf):
        n = len(variant)
        row = np.repeat(np.arange(n), np.asarray(idx.value_lengths()))
        at = variant[row] * weights.shape[1] + np.asarray(idx.flatten(), dtype=np.int64)
        value = np.asarray(tf.flatten(), dtype=np.float64) * idf.ravel()[at]
        size = np.sqrt(np.bincount(row, value * value, n))
        value *= np.divide(1.0, size, out=np.zeros(n), where=size > 0)[row]
        return row, at, value, np.bincount(row, value * weights.ravel()[at], n) + bias[variant]

    return margins


def _scaled_blocks(train: DataFrame, idf) -> DataFrame:
    """(variant, label, size, at, value), stored: the rows' labels, numbers of terms, buckets and scaled values as bytes, in blocks
    of one variant and about ``_TERMS`` terms. ``idf`` is broadcast already. The scaling is done here once, not in every step."""
    most = _TERMS

    def run(batches):
        f, held = idf.value, {}

        def block(v):
            y, size, at, value = (np.concatenate(x) for x in zip(*held.pop(v)[1], strict=True))
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (y, size, at, value)]],
                                              names=["variant", "label", "size", "at", "value"])

        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                variant, y = np.asarray(batch.column(0), dtype=np.int64), np.asarray(batch.column(1))
                size = np.asarray(batch.column(2).value_lengths(), dtype=np.int32)
                row, at = np.repeat(np.arange(len(y)), size), np.asarray(batch.column(2).flatten(), dtype=np.int32)
                value = np.asarray(batch.column(3).flatten(), dtype=np.float64) * f[variant[row], at]
                length = np.sqrt(np.bincount(row, value * value, len(y)))
                value *= np.divide(1.0, length, out=np.zeros(len(y)), where=length > 0)[row]
                for v in np.unique(variant).tolist():
                    own = variant == v
                    terms = own[row]
                    n, parts = held.get(v, (0, []))
                    held[v] = n + int(terms.sum()), [*parts, (y[own], size[own], at[terms], value[terms])]
                    if held[v][0] >= most:
                        yield block(v)
        for v in list(held):
            yield block(v)

    rows = train.select("variant", "label", "idx", "tf")
    return materialize(rows.mapInArrow(run, "variant int, label binary, size binary, at binary, value binary"))


def _loss_and_gradient(blocks: DataFrame, weights: np.ndarray, bias: np.ndarray):
    """Per variant: rows, summed loss, gradient of the intercept, gradient of the weights. One job for all of them, with a task a
    core: a task's gradient is summed over all its blocks, so what is shuffled does not grow with the rows."""
    spark, k, size = blocks.sparkSession, len(bias), _PART
    shared = spark.sparkContext.broadcast((weights, bias))

    def run(batches):
        w, b = shared.value
        grad, per = np.zeros_like(w), np.zeros((3, k))
        for batch in batches:
            for i in range(batch.num_rows):
                v = batch.column(0)[i].as_py()
                y, n, at, value = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in ((1, "<f8"), (2, "<i4"), (3, "<i4"), (4, "<f8")))
                row = np.repeat(np.arange(len(y)), n)
                m = np.bincount(row, value * w[v][at], len(y)) + b[v]
                off = 1 / (1 + np.exp(-np.clip(m, -500, 500))) - y
                grad[v] += np.bincount(at, value * off[row], w.shape[1])
                per[:, v] += len(y), (np.logaddexp(0, m) - y * m).sum(), off.sum()
        flat = np.concatenate([per.ravel(), grad.ravel()])
        parts = [(p, x.tobytes()) for p, x in ((p, flat[p * size:(p + 1) * size]) for p in range(-(-len(flat) // size))) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())],
                                         names=["part", "v"])

    def added(batches):
        total = {}
        for batch in batches:
            for p, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(x.as_buffer(), "<f8")
                total[p] = total[p] + x if p in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())],
                                         names=["part", "v"])

    tasks = spark.sparkContext.defaultParallelism
    got = (blocks.coalesce(tasks).mapInArrow(run, "part int, v binary").repartition(tasks, "part")
           .mapInArrow(added, "part int, v binary").toArrow())  # variants x (buckets + 3) numbers
    shared.destroy()
    flat = np.zeros(3 * k + weights.size)
    for p, x in zip(got.column(0).to_pylist(), got.column(1), strict=True):
        x = np.frombuffer(x.as_buffer(), "<f8")
        flat[p * size:p * size + len(x)] = x
    per = flat[:3 * k].reshape(3, k)
    return per[0], per[1], per[2], flat[3 * k:].reshape(weights.shape)


def _direction(g: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    q, kept = g.copy(), []
    for s, y in reversed(steps):
        a = (s @ q) / (s @ y)
        q -= a * y
        kept.append(a)
    if steps:
        s, y = steps[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(steps, reversed(kept), strict=True):
        q += s * (a - (y @ q) / (s @ y))
    return -q


def fit_together(rows: DataFrame, names: list[str], buckets: int, reg: float = 0.001, max_evaluations: int = 100,
                 tol: float = 1e-6) -> Fit:
    """One classifier a variant from the rows of :func:`variant_rows` that are not test rows and have a label; the loss is the
    mean log loss plus ``reg`` / 2 times the squared weights (not the intercept). A variant whose gradient is below
    ``tol`` in every place is done and its rows are no longer read."""
    k = len(names)
    train = rows.filter("not test and label is not null")
    seen = train.select("variant", F.explode("idx").alias("i")).groupBy("variant", "i").agg(F.count(F.lit(1)).alias("n"))
    df = seen.toArrow()  # at most variants x buckets rows
    per = dict(train.groupBy("variant").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a variant
    idf = np.zeros((k, buckets))
    idf[np.asarray(df.column(0)), np.asarray(df.column(1))] = np.asarray(df.column(2))
    idf = np.log((np.array([per.get(v, 0) for v in range(k)])[:, None] + 1) / (idf + 1))
    x = np.zeros((k, buckets + 1))
    out = Fit(names, x[:, :-1], x[:, -1], idf)
    if not per:
        return out

    shared = rows.sparkSession.sparkContext.broadcast(idf)
    blocks = _scaled_blocks(train, shared)
    shared.destroy()

    def measured(points, active):
        n, loss, db, dw = _loss_and_gradient(blocks.filter(F.col("variant").isin(active)), points[:, :-1], points[:, -1])
        out.evaluations += 1
        n = np.maximum(n, 1)
        g = np.concatenate([dw / n[:, None] + reg * points[:, :-1], (db / n)[:, None]], axis=1)
        return loss / n + reg / 2 * (points[:, :-1] ** 2).sum(1), g

    active = sorted(per)
    f, g = measured(x, active)
    steps: dict[int, list] = {v: [] for v in active}
    way, t = -g, np.ones(k)
    active = [v for v in active if np.abs(g[v]).max() > tol]
    while active and out.evaluations < max_evaluations:
        trial = x.copy()
        trial[active] += t[active, None] * way[active]
        f_new, g_new = measured(trial, active)
        for v in list(active):
            if f_new[v] > f[v] + 1e-4 * t[v] * (g[v] @ way[v]):
                t[v] /= 2
                if t[v] < 1e-9:
                    active.remove(v)
                continue
            s, y = trial[v] - x[v], g_new[v] - g[v]
            if s @ y > 1e-14:
                steps[v] = [*steps[v], (s, y)][-MEMORY:]
            x[v], f[v], g[v], t[v] = trial[v], f_new[v], g_new[v], 1.0
            way[v] = _direction(g[v], steps[v])
            if np.abs(g[v]).max() <= tol:
                active.remove(v)
    return out


def score_variants(rows: DataFrame, fit: Fit, key: str) -> DataFrame:
    """(<key>, label, variant, logit, prob, pred) of every row of :func:`variant_rows`, with the variant's name."""
    shared, margins, names = rows.sparkSession.sparkContext.broadcast((fit.weights, fit.bias, fit.idf)), _margins(), fit.names

    def run(batches):
        for b in batches:
            variant = np.asarray(b.column(2), dtype=np.int64)
            m = margins(variant, b.column(3), b.column(4), *shared.value)[3]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([names[v] for v in variant], pa.string()), pa.array(m)],
                                             names=[key, "label", "variant", "logit"])

    kind = rows.select(key).schema[0].dataType.simpleString()
    s = rows.select(key, "label", "variant", "idx", "tf").mapInArrow(run, f"`{key}` {kind}, label double, variant string, logit double")
    prob = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("logit")))
    return s.select(key, F.col("label").cast("int").alias("label"), "variant", "logit", prob.alias("prob"),
                    (F.col("logit") > 0).cast("int").alias("pred"))
