"""Bootstrap without draw rows (E14): hierarchical multinomial splitting.

A bootstrap round draws n of n rows with replacement, so the number of times
that each distinct score is drawn is multinomial. A multinomial can be split:
first the n draws over bins of the score, then each bin's draws over its scores,
all by seeded binomials. The rows are therefore counted once per distinct
score; a round costs one vector operation per score and one result row per bin,
never a row per draw.

The bins are fixed (equal parts of [0, 1], the ends take what lies outside), and
each (round, bin) has its own seed, so the draws do not depend on how the table is
partitioned. Bins are in score order: within a bin the pairs of a positive and a
lower negative are counted there, and pairs across bins come from the bins' totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markspark.operators.evaluate import report_from_counts
from markspark.session import materialize

BINS = 4096
#: Distinct scores that are drawn at once.
_CHUNK = 4096
_KINDS = ("tp", "fn", "fp", "tn")
_SUMS = "round int, bin int, tp long, fn long, fp long, tn long, pairs double"


def score_counts(scored: DataFrame, label: str = "label", prob: str = "prob", pred: str = "pred", bins: int = BINS) -> DataFrame:
    """(bin, prob, tp, fn, fp, tn): rows of each distinct score by label (1 or not) and prediction (1 or not); null is the
    lowest score."""
    y, p, s = F.col(label).eqNullSafe(1), F.col(pred).eqNullSafe(1), F.col(prob).cast("double")
    bin_ = F.when(s.isNull() | (s < 0), 0).when(F.isnan(s) | (s >= 1), bins - 1).otherwise(F.floor(s * bins)).cast("int")
    return scored.groupBy(bin_.alias("bin"), s.alias("prob")).agg(
        F.count_if(y & p).alias("tp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"))


def split_bins(totals: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """(rounds, bins) draws: in every round as many as there are rows."""
    n = int(totals.sum())
    return np.stack([np.random.default_rng([seed, r]).multinomial(n, totals / n) for r in range(rounds)])


class BinDraws:
    """The draws of one bin's scores, taken chunk by chunk in score order, for all rounds."""

    def __init__(self, bin_: int, rows: int, draws: np.ndarray, seed: int):
        self.left_rows, self.left_draws = rows, draws.astype(np.int64).copy()
        self.rng = [np.random.default_rng([seed, r, bin_]) for r in range(len(draws))]
        self.counts = np.zeros((len(draws), len(_KINDS)), np.int64)
        self.pairs = np.zeros(len(draws))

    def take(self, cells: np.ndarray) -> np.ndarray:
        """Draw the next scores' ``cells`` (score, kind) of counts; returns (round, score, kind) of draws."""
        rows, flat = int(cells.sum()), cells.reshape(-1)
        w = np.zeros((len(self.rng), flat.size), np.int64)
        for r, rng in enumerate(self.rng):
            here = self.left_draws[r] if rows == self.left_rows else rng.binomial(self.left_draws[r], rows / self.left_rows)
            self.left_draws[r] -= here
            w[r] = rng.multinomial(here, flat / rows)
        self.left_rows -= rows
        w = w.reshape(len(self.rng), *cells.shape)
        positive, negative = w[:, :, 0] + w[:, :, 1], w[:, :, 2] + w[:, :, 3]
        below = (self.counts[:, 2] + self.counts[:, 3])[:, None] + np.cumsum(negative, 1) - negative
        self.pairs += (positive * (below + negative / 2)).sum(1)
        self.counts += w.sum(1)
        return w


def _bin_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(bin, cells, whether it is the bin's last chunk) of rows sorted by bin and score; chunks do not depend on the batches."""
    bin_, held = None, np.zeros((0, len(_KINDS)), np.int64)
    for batch in batches:
        bins = batch.column(0).to_numpy()
        cells = np.stack([batch.column(i).to_numpy() for i in range(1, 5)], 1)
        for b in np.unique(bins).tolist():
            if b != bin_:
                if bin_ is not None:
                    yield bin_, held, True
                bin_, held = b, held[:0]
            held = np.concatenate([held, cells[bins == b]])
            while len(held) > _CHUNK:
                yield bin_, held[:_CHUNK], False
                held = held[_CHUNK:]
    if bin_ is not None:
        yield bin_, held, True


def round_sums(counts: DataFrame, rounds: int, seed: int) -> DataFrame:
    """(round, bin, tp, fn, fp, tn, pairs) for :func:`score_counts`; pairs are those inside the bin."""
    cells = materialize(counts.repartitionByRange("bin").sortWithinPartitions("bin", "prob").select("bin", *_KINDS))
    rows = cells.groupBy("bin").agg(F.sum(F.expr("tp + fn + fp + tn")).alias("n")).collect()  # BINS rows at most
    totals = {r.bin: r.n for r in sorted(rows)}
    draws = split_bins(np.array(list(totals.values()), np.int64), rounds, seed) if totals else np.zeros((rounds, 0), np.int64)
    share = {b: (n, draws[:, i]) for i, (b, n) in enumerate(totals.items())}  # rounds x BINS numbers at most

    def run(batches):
        at, held = None, None
        for b, chunk, last in _bin_chunks(batches):
            if b != at:
                at, held = b, BinDraws(b, share[b][0], share[b][1], seed)
            held.take(chunk)
            if last:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(rounds, dtype=np.int32)), pa.array(np.full(rounds, b, np.int32)),
                     *[pa.array(held.counts[:, i]) for i in range(4)], pa.array(held.pairs)],
                    names=[c.split(" ")[0] for c in _SUMS.split(", ")])

    return cells.mapInArrow(run, _SUMS)


def split_bootstrap(scored: DataFrame, rounds: int = 30, seed: int = 42, label: str = "label", prob: str = "prob",
                    pred: str = "pred") -> DataFrame:
    """(round, n, accuracy, auc, precision, recall, f1) of ``rounds`` bootstrap rounds; weighted averages over both
    classes. An empty table has no round; without both classes the AUC is null."""
    sums = round_sums(score_counts(scored, label, prob, pred), rounds, seed)
    lower = Window.partitionBy("round").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows at most
    positive, negative = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    pairs = F.col("pairs") + positive * F.coalesce(F.sum(negative).over(lower), F.lit(0))
    per_round = materialize(sums.withColumn("_pairs", pairs).groupBy("round").agg(
        *[F.sum(k).alias(k) for k in _KINDS], F.sum("_pairs").alias("_pairs")).withColumn("n", F.expr("tp + fn + fp + tn")))
    report = report_from_counts(per_round.select("round", *_KINDS, "n"), ["round"])
    acc = report.filter("class_name = 'accuracy'").select("round", F.col("f1").alias("accuracy"))
    avg = report.filter("class_name = 'weighted avg'").select("round", "precision", "recall", "f1")
    auc = per_round.select("round", "n", F.try_divide(F.col("_pairs"), positive.cast("double") * negative).alias("auc"))
    return acc.join(auc, "round").join(avg, "round").select("round", "n", "accuracy", "auc", "precision", "recall", "f1")
