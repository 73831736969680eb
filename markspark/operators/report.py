"""The full evaluation report (E13) from one scan, and its sink.

Scored rows are counted once by (probability, label, prediction): the score cube.
It is stored, put in score order once, and every section is derived from it, so
the scored table is read a single time whatever the report holds. The cube has a
row per distinct score at most, also where one score holds a third of the rows.

The sink writes all sections under a new version and then one commit marker.
Readers see the last committed version only: a report that failed half-way is
never read, and readers of the old one are not disturbed.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markspark.functions.numeric import pct, round_even
from markspark.operators.evaluate import arange, report_from_counts, uniform_bin
from markspark.operators.order import ntile_of, prefix_sums
from markspark.session import materialize

_COMMIT = "version string, sections array<string>"


def score_cube(scored: DataFrame, label: str = "label", prob: str = "prob", pred: str = "pred") -> DataFrame:
    """(prob, label, pred, n): how many rows have each score, label and prediction; stored."""
    return materialize(scored.groupBy(F.col(prob).cast("double").alias("prob"), F.col(label).alias("label"), F.col(pred).alias("pred"))
                       .agg(F.count(F.lit(1)).alias("n")))


def _deciles(run: DataFrame, cuts: int) -> DataFrame:
    """The decile chart of rows in score order (ties: label, then prediction); a cube row lies in one tile or in several."""
    total, first, last = F.col("tot_n"), F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    low = lambda t: t * F.floor(total / F.lit(cuts)) + F.least(t, total % F.lit(cuts))
    t = F.col("tile").cast("long")
    rows = run.withColumn("tile", F.explode(F.sequence(ntile_of(first, total, cuts), ntile_of(last, total, cuts))))
    rows = rows.withColumn("_w", F.least(F.col("cum_n"), low(t)) - F.greatest(first, low(t - 1)))
    w, y, p = F.col("_w"), F.col("label"), F.col("pred")
    part = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0)).cast("long")
    g = rows.groupBy("tile").agg(F.sum(w).cast("long").alias("n"), part(y == 1).alias("n_1"), part(p == 1).alias("pred_1"),
                                 part((y == 1) & (p == 1)).alias("tp"), part((y == 0) & (p == 0)).alias("tn"))
    g = g.select("tile", "n", (F.col("n") - F.col("n_1")).alias("n_0"), "n_1", (F.col("n") - F.col("pred_1")).alias("pred_0"), "pred_1",
                 pct(F.col("tp") + F.col("tn"), F.col("n")).alias("acc"), pct(F.col("tp"), F.col("pred_1")).alias("prec"),
                 pct(F.col("tp"), F.col("n_1")).alias("recall"))
    f1 = F.try_divide(F.lit(2.0) * F.col("prec") * F.col("recall"), F.col("prec") + F.col("recall"))
    return g.withColumn("f1", round_even(f1, 0))


def _thresholds(cube: DataFrame, ths: list[float]) -> DataFrame:
    n, y, p = F.col("n"), F.col("label") == 1, F.col("prob")
    part = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    one = cube.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n_total"), part(y).alias("n1_actual"),
                   *[x for i, t in enumerate(ths) for x in (part(p >= F.lit(t)).alias(f"p{i}"), part((p >= F.lit(t)) & y).alias(f"tp{i}"),
                                                            part((p < F.lit(t)) & ~y).alias(f"tn{i}"), part(p < F.lit(t)).alias(f"m{i}"))])
    each = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"p{i}").alias("p"), F.col(f"tp{i}").alias("tp"), F.col(f"tn{i}").alias("tn"),
                              F.col(f"m{i}").alias("m")) for i, t in enumerate(ths)])
    x = one.select("n_total", "n1_actual", F.explode(each).alias("_t")).select("n_total", "n1_actual", "_t.*")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return x.select("threshold", share("tn", "m").alias("prec0"), share("tp", "p").alias("prec1"),
                    (F.col("n_total") - F.col("n1_actual")).alias("n0_actual"), "n1_actual",
                    (F.col("n_total") - F.col("p")).alias("n0_pred"), F.col("p").alias("n1_pred"), "n_total")


def sections(cube: DataFrame, cuts: int = 10, bins: int = 10, thresholds: list[float] | None = None) -> dict[str, DataFrame]:
    """Every section of the report from a :func:`score_cube`: confusion, classes, auc, roc, calibration, histogram, precision,
    deciles. Rows without a probability are in the first two only. An empty cube gives empty sections, the one-row
    and fixed-row sections with nulls or zeros."""
    n, y, p = F.col("n"), F.col("label"), F.col("pred")
    part = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    counts = cube.agg(part((y == 1) & (p == 1)).alias("tp"), part((y == 0) & (p == 0)).alias("tn"), part((y == 0) & (p == 1)).alias("fp"),
                      part((y == 1) & (p == 0)).alias("fn"), F.coalesce(F.sum(n), F.lit(0)).alias("n"))
    pairs = cube.groupBy("label", "pred").agg(F.sum("n").alias("n"))
    scored = cube.filter("prob is not null")
    positive, negative = F.when(y == 1, n).otherwise(0), F.when(y == 1, 0).otherwise(n)
    run = materialize(prefix_sums(scored, [F.col("prob").desc(), "label", "pred"], {"n": n, "pos": positive, "neg": negative}))
    points = run.groupBy("prob").agg(F.sum(positive).alias("pos"), F.sum(negative).alias("neg"), *[
        F.max(c).alias(c) for c in ("cum_pos", "cum_neg", "tot_pos", "tot_neg")])
    area = F.sum(F.col("pos") * (F.col("tot_neg") - F.col("cum_neg") + F.col("neg") / 2.0))
    zero = scored.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    low, high, total = scored.agg(F.min("prob"), F.max("prob"), F.sum("n")).first()
    span = (high - low) if total else 0.0
    slot = F.least(F.floor((F.col("prob") - F.lit(low)) * F.lit(float(bins)) / F.lit(span)), F.lit(bins - 1)) if span else F.lit(0)
    rows = cube.agg(F.sum("n")).first()[0]
    return {
        "confusion": pairs.withColumn("share", F.col("n") / F.lit(rows or 1)),
        "classes": report_from_counts(counts),
        "auc": points.agg(F.try_divide(area, F.max("tot_pos") * F.max("tot_neg")).alias("auc")),
        "roc": points.select(F.col("prob").alias("threshold"), F.try_divide(F.col("cum_neg"), F.col("tot_neg")).alias("fpr"),
                             F.try_divide(F.col("cum_pos"), F.col("tot_pos")).alias("tpr")).unionByName(zero),
        "calibration": scored.groupBy(uniform_bin("prob", bins).alias("bin")).agg(
            (F.sum(F.col("prob") * n) / F.sum("n")).alias("mean_prob"), (F.sum(positive) / F.sum("n")).alias("frac_pos"), F.sum("n").alias("n")),
        "histogram": scored.groupBy(slot.cast("int").alias("bin")).agg(F.sum("n").alias("n")).withColumn("share", F.col("n") / F.lit(total or 1)),
        "precision": _thresholds(scored, thresholds or arange(0.1, 1.0, 0.1)),
        "deciles": _deciles(run, cuts),
    }


def publish(parts: dict[str, DataFrame], path: str, check: Callable[[], None] | None = None) -> str:
    """Write all ``parts`` as one version below ``path`` and commit it; returns the version. ``check`` runs between the two:
    if it raises, nothing is committed."""
    spark = next(iter(parts.values())).sparkSession
    version = f"v{time.time_ns():020d}-{uuid.uuid4().hex}"
    for name, part in parts.items():
        part.write.parquet(f"{path}/{version}/{name}")
    if check:
        check()
    # the only step that makes the version visible: one file, put in place at once by the writer's own commit
    spark.createDataFrame([(version, sorted(parts))], _COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return version


def read_published(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The parts of the last committed version."""
    last = spark.read.schema(_COMMIT).parquet(f"{path}/commits").orderBy(F.col("version").desc()).first()
    return {name: spark.read.parquet(f"{path}/{last.version}/{name}") for name in last.sections}
