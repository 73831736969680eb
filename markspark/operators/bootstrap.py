"""Bootstrap of evaluation metrics.

The model scores once; rounds resample the scored rows. Exact draws:
``rounds x n`` draw ids, each mapped to a row index by md5(seed, round, k)
mod n. A task makes the draws of a run of k for all rounds and deals them out
by blocks of row indices, two bytes a draw; a block's draws meet its indexed
rows in one cogroup and leave as counts by (round, score, label, pred).
Poisson draws: every row gets a Poisson(1) weight per round from the same hash
in the scan; the weights leave it summed by (round, score, label, pred).
No draw is a row of its own. Rounds are independent (the
reference resampled the previous round's sample; see README).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markspark.functions.draws import counted_heads, text_heads
from markspark.operators.evaluate import report_from_counts
from markspark.operators.order import global_index, prefix_sums
from markspark.session import materialize

#: Draws that a task makes, and weights that it holds, at once; most draws of a block of row indices that meet its rows.
_MADE, _MET = 1 << 22, 1 << 20


def block_bits(rounds: int) -> int:
    """A block has 2 to this row indices: about ``_MET`` draws in all rounds."""
    return min(15, max(8, (_MET // max(rounds, 1)).bit_length() - 1))


def draws(spark, n: int, rounds: int, seed: int) -> DataFrame:
    """(block, counts, places): ``rounds`` samples of ``n`` row indices with replacement. A row has the draws that one run of
    numbers k gives to one block of indices: how many in each round (int32), and their places in the block (uint16),
    round by round."""
    parallel, bits = spark.sparkContext.defaultParallelism, block_bits(rounds)
    size = max(1, min(_MADE // rounds, -(-n // (2 * parallel))))
    heads, prefixes = counted_heads(), [f"{seed}|{r}|".encode() for r in range(rounds)]

    def run(batches):
        for batch in batches:
            for first in batch.column(0).to_pylist():
                made = []
                for _, r, h in heads(prefixes, first, min(n, first + size)):
                    idx = h % np.uint64(n)
                    made.append(idx >> np.uint64(bits) << np.uint64(32) | np.uint64(r << bits) | idx & np.uint64((1 << bits) - 1))
                made = np.sort(np.concatenate(made))
                block = (made >> np.uint64(32)).astype(np.int64)
                at = np.flatnonzero(np.diff(block, prepend=-1))
                row = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(made))))
                r = (made & np.uint64(0xFFFFFFFF)).astype(np.int64) >> bits
                counts = np.bincount(row * rounds + r, minlength=len(at) * rounds).astype("<i4")
                places = (made & np.uint64((1 << bits) - 1)).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[at]),
                     pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.arange(len(at) + 1, dtype=np.int32) * 4 * rounds), pa.py_buffer(counts)]),
                     pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(made)).astype(np.int32) * 2), pa.py_buffer(places)])],
                    names=["block", "counts", "places"])

    runs = spark.range(0, n, size, max(1, -(-n // size)))
    return runs.mapInArrow(run, "block long, counts binary, places binary")


def _coded():
    """A function giving each row's number among the distinct rows of some columns, and one row of each."""
    def coded(columns):
        code = np.zeros(len(columns[0]), np.int64)
        for c in columns:
            c = c.dictionary_encode(null_encoding="encode")
            code = np.unique(code * max(1, len(c.dictionary)) + c.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        return code, np.unique(code, return_index=True)[1]

    return coded


_SCORED = ("prob", "label", "pred")


def _weights_schema(slim: DataFrame) -> str:
    kind = dict(slim.dtypes)
    return "round int, " + ", ".join(f"{c} {kind[c]}" for c in _SCORED) + ", w long"


def drawn_weights(indexed: DataFrame, drawn: DataFrame, rounds: int) -> DataFrame:
    """(round, prob, label, pred, w) of ``indexed(idx, prob, label, pred)``: how often rows like that are in ``drawn``, summed by
    block of indices."""
    bits, coded, scored = block_bits(rounds), _coded(), _SCORED

    def meet(drawn, rows):
        def whole(table, name):
            c = table.column(name)
            return pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)

        columns = [whole(rows, c) for c in scored]
        if not drawn.num_rows or not rows.num_rows:
            cells, w, group, first = np.zeros(0, np.int64), np.zeros(0, np.int64), 1, np.zeros(0, np.int64)
        else:
            code, first = coded(columns)
            at, group = np.zeros(1 << bits, np.int64), len(first)
            at[whole(rows, "place").to_numpy()] = code
            counts = np.frombuffer(b"".join(whole(drawn, "counts").to_pylist()), "<i4")
            places = np.frombuffer(b"".join(whole(drawn, "places").to_pylist()), "<u2")
            r = np.repeat(np.tile(np.arange(rounds), drawn.num_rows), counts)
            cells, w = np.unique(r * group + at[places], return_counts=True)
        like = first[cells % group] if len(cells) else cells
        return pa.table([pa.array((cells // group).astype(np.int32)), *[c.take(pa.array(like)) for c in columns], pa.array(w.astype(np.int64))],
                        names=["round", *scored, "w"])

    rows = indexed.select(F.shiftright("idx", bits).alias("block"), F.col("idx").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("place"), *scored)
    return drawn.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(meet, _weights_schema(indexed))


def poisson_weights(slim: DataFrame, key: list[str], rounds: int, seed: int) -> DataFrame:
    """(round, prob, label, pred, w) of ``slim(key..., prob, label, pred)``: the Poisson(1) weights of rows like that, summed by
    run of rows; weight 0 too."""
    heads, prefixes, cdf = text_heads(), [f"{seed}|{r}".encode() for r in range(rounds)], poisson1_cdf()
    coded, scored, size = _coded(), _SCORED, max(1 << 10, min(1 << 17, _MADE // max(rounds, 1)))

    def run_of(held):
        table = pa.Table.from_batches(held).combine_chunks()
        text, *columns = [pa.concat_arrays(c.chunks) for c in table.columns]
        off = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        code, first = coded(columns)
        weights = np.zeros((rounds, len(first)))
        for rows, r, h in heads(prefixes, data, off):
            u = h.astype(np.float64) / float(1 << 60)
            w = np.zeros(len(u))
            for c in cdf:
                more = u >= c
                if not more.any():
                    break
                w += more
            weights[r] += np.bincount(code[rows], w, len(first))
        like = pa.array(np.tile(first, rounds))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(rounds, dtype=np.int32), len(first))), *[c.take(like) for c in columns],
             pa.array(weights.ravel().astype(np.int64))], names=["round", *scored, "w"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= size:
                yield run_of(held)
                held, n = [], 0
        if n:
            yield run_of(held)

    text = F.concat_ws("|", F.lit(""), *[F.col(k).cast("string") for k in key]).alias("_text")
    return slim.select(text, *_SCORED).mapInArrow(run, _weights_schema(slim))


def poisson1_cdf(kmax: int = 16) -> list[float]:
    """P(X <= k) of Poisson(1) for k < kmax (the inverse-CDF thresholds)."""
    out, cdf, p = [], 0.0, math.exp(-1.0)
    for k in range(kmax):
        cdf += p
        p /= (k + 1)
        out.append(cdf)
    return out


def _round_metrics(w: DataFrame) -> DataFrame:
    """Per round: accuracy, AUC, weighted precision/recall/f1 from rows with
    columns (round, label, prob, pred, w).

    The rows are first reduced to weights per (round, score, label, pred)
    and that aggregate is checkpointed: the confusion counts and the score
    table both read it, so the draws are computed once."""
    w = materialize(w.groupBy("round", "prob", "label", "pred").agg(F.sum("w").alias("w")))
    y, p, wt = F.col("label"), F.col("pred"), F.col("w")
    counts = w.groupBy("round").agg(
        F.sum(F.when((y == 1) & (p == 1), wt).otherwise(0)).alias("tp"),
        F.sum(F.when((y == 0) & (p == 0), wt).otherwise(0)).alias("tn"),
        F.sum(F.when((y == 0) & (p == 1), wt).otherwise(0)).alias("fp"),
        F.sum(F.when((y == 1) & (p == 0), wt).otherwise(0)).alias("fn"),
        F.sum(wt).alias("n"))
    rep = report_from_counts(counts, ["round"])
    acc = rep.filter("class_name = 'accuracy'").select("round", F.col("f1").alias("accuracy"))
    wavg = rep.filter("class_name = 'weighted avg'").select("round", "precision", "recall", "f1")
    st = w.groupBy("round", F.col("prob").alias("score")).agg(
        F.sum(F.when(y == 1, wt).otherwise(0)).alias("pos"), F.sum(F.when(y != 1, wt).otherwise(0)).alias("neg"))
    rt = prefix_sums(st, [F.col("score").desc()], {"pos": "pos", "neg": "neg"}, partition_by=["round"])
    term = F.col("pos") * (F.col("tot_neg") - F.col("cum_neg") + F.col("neg") / F.lit(2.0))
    auc = rt.groupBy("round").agg(F.try_divide(F.sum(term), F.first("tot_pos") * F.first("tot_neg")).alias("auc"))
    return acc.join(auc, "round").join(wavg, "round").select("round", "accuracy", "auc", "precision", "recall", "f1")


def bootstrap(scored: DataFrame, key: list[str], rounds: int = 30, seed: int = 42,
              method: str = "exact", label: str = "label", prob: str = "prob", pred: str = "pred") -> DataFrame:
    """Per round: accuracy, AUC, weighted precision, recall and f1."""
    slim = scored.select(*key, F.col(label).alias("label"), F.col(prob).alias("prob"), F.col(pred).alias("pred"))
    if method == "poisson":
        return _round_metrics(poisson_weights(slim, key, rounds, seed))
    if method != "exact":
        raise ValueError(f"unknown bootstrap method {method!r}")
    # the key orders the rows; the scored columns break any tie in the key
    ix = global_index(slim, [F.col(k) for k in key] + [F.col(c) for c in _SCORED], keep=list(_SCORED))
    n = ix.count()
    if n == 0:
        return scored.sparkSession.createDataFrame([], "round int, accuracy double, auc double, precision double, recall double, f1 double")
    return _round_metrics(drawn_weights(ix, draws(scored.sparkSession, n, rounds, seed), rounds))


def bootstrap_summary(results: DataFrame, metrics=("accuracy", "auc", "precision", "recall", "f1"),
                      qs=(0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0), z: float = 1.96) -> DataFrame:
    """Per metric: count, mean, sample std, the normal confidence band
    and interpolated quantiles ``q0..``. The rounds table is unpivoted to
    (metric, value) and summarised by one grouped aggregate (one pass)."""
    stack = ", ".join(f"'{m}', cast(`{m}` as double)" for m in metrics)
    long = results.selectExpr(f"stack({len(metrics)}, {stack}) as (metric, value)")
    arr = F.array(*[F.lit(float(q)) for q in qs])
    g = long.groupBy("metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"),
                                   F.stddev_samp("value").alias("std"), F.percentile("value", arr).alias("_q"))
    half = F.lit(float(z)) * F.col("std") / F.sqrt(F.col("n"))
    return g.select("metric", "n", "mean", "std", (F.col("mean") - half).alias("ci_lo"),
                    (F.col("mean") + half).alias("ci_hi"), *[F.col("_q")[i].alias(f"q{i}") for i in range(len(qs))])
