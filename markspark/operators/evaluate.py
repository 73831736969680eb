"""Evaluation of scored rows.

Everything starts with one aggregate over the scored table (confusion
counts, per-score counts, per-bin counts); what follows runs on the small
aggregated table. ROC/AUC use the distinct-score table and distributed
prefix sums (see :mod:`markspark.operators.order`), never a global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markspark.functions.numeric import round_even
from markspark.operators.order import prefix_sums


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def confusion_counts(scored: DataFrame, label="label", pred="pred", by: list[str] | None = None) -> DataFrame:
    """tp, tn, fp, fn and n in one aggregate (per group when ``by``)."""
    y, p = _c(label), _c(pred)
    return scored.groupBy(*(by or [])).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count(F.lit(1)).alias("n"))


def confusion(scored: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Long-form confusion matrix (label, pred, n, share of all rows)."""
    g = scored.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    # at most 4 rows: the share is a projection over the aggregated table
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return g.withColumn("share", F.col("n") / total)


def accuracy(scored: DataFrame, label="label", pred="pred", by: list[str] | None = None) -> DataFrame:
    """Share of rows with label == pred."""
    return scored.groupBy(*(by or [])).agg(F.avg((_c(label) == _c(pred)).cast("double")).alias("accuracy"))


def _div0(a: Column, b: Column) -> Column:
    """a/b with 0.0 for 0/0 (the report's zero-division default)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def report_from_counts(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """E3 from confusion counts: per class 0/1, macro and weighted averages
    and the accuracy row (precision, recall, f1, support)."""
    by = list(by or [])
    tp, tn, fp, fn, n = (F.col(c) for c in ("tp", "tn", "fp", "fn", "n"))
    p1, r1 = _div0(tp, tp + fp), _div0(tp, tp + fn)
    p0, r0 = _div0(tn, tn + fn), _div0(tn, tn + fp)
    f = lambda p, r: _div0(F.lit(2.0) * p * r, p + r)
    s1, s0 = tp + fn, tn + fp
    c = (counts.withColumn("p1", p1).withColumn("r1", r1).withColumn("p0", p0).withColumn("r0", r0)
         .withColumn("s1", s1).withColumn("s0", s0))
    c = c.withColumn("f1_1", f(F.col("p1"), F.col("r1"))).withColumn("f1_0", f(F.col("p0"), F.col("r0")))
    w = lambda a, b: F.try_divide(a * F.col("s0") + b * F.col("s1"), F.col("n"))  # noqa: E731 - null without rows
    rows = [
        ("0", F.col("p0"), F.col("r0"), F.col("f1_0"), F.col("s0")),
        ("1", F.col("p1"), F.col("r1"), F.col("f1_1"), F.col("s1")),
        ("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), _div0(tp + tn, n), n),
        ("macro avg", (F.col("p0") + F.col("p1")) / 2, (F.col("r0") + F.col("r1")) / 2,
         (F.col("f1_0") + F.col("f1_1")) / 2, n),
        ("weighted avg", w(F.col("p0"), F.col("p1")), w(F.col("r0"), F.col("r1")),
         w(F.col("f1_0"), F.col("f1_1")), n),
    ]
    arr = F.array(*[F.struct(F.lit(k).alias("class_name"), p.alias("precision"), r.alias("recall"),
                             f1.alias("f1"), s.cast("bigint").alias("support")) for k, p, r, f1, s in rows])
    return c.select(*by, F.explode(arr).alias("_r")).select(*by, "_r.*")


def classification_report(scored: DataFrame, label="label", pred="pred", by: list[str] | None = None) -> DataFrame:
    """The classification report as a table."""
    return report_from_counts(confusion_counts(scored, label, pred, by), by)


def report_at(scored: DataFrame, th: float | Column, prob="prob", label="label", by=None) -> DataFrame:
    """Classification report after thresholding ``prob`` at ``th``."""
    t = th if isinstance(th, Column) else F.lit(float(th))
    s = scored.withColumn("_pred_th", (_c(prob) >= t).cast("int"))
    return classification_report(s, label, "_pred_th", by)


def score_table(scored: DataFrame, prob="prob", label="label", by: list[str] | None = None) -> DataFrame:
    """Distinct-score table: positives and negatives per score (per group)."""
    y = _c(label)
    return scored.groupBy(*(by or []), _c(prob).alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg"))


def roc_table(scored: DataFrame, prob="prob", label="label", by: list[str] | None = None) -> DataFrame:
    """Per distinct score (descending): cumulative tp/fp, totals P/N."""
    st = score_table(scored, prob, label, by)
    return prefix_sums(st, [F.col("score").desc()], {"pos": "pos", "neg": "neg"}, partition_by=by)


def roc_curve(scored: DataFrame, prob="prob", label="label", by: list[str] | None = None) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, plus the origin
    (threshold NULL). AUC is unaffected by dropping collinear points."""
    by = list(by or [])
    rt = roc_table(scored, prob, label, by)
    pts = rt.select(*by, F.col("score").alias("threshold"),
                    F.try_divide(F.col("cum_neg").cast("double"), F.col("tot_neg")).alias("fpr"),
                    F.try_divide(F.col("cum_pos").cast("double"), F.col("tot_pos")).alias("tpr"))
    origin = pts.select(*by).distinct() if by else pts.sparkSession.range(1).select()
    origin = origin.select(*by, F.lit(None).cast("double").alias("threshold"),
                           F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


def auc(scored: DataFrame, prob="prob", label="label", by: list[str] | None = None) -> DataFrame:
    """E5: ROC AUC with ties counted one half:
    sum_s pos_s * (negatives below s + neg_s / 2) / (P * N)."""
    by = list(by or [])
    rt = roc_table(scored, prob, label, by)
    below = F.col("tot_neg") - F.col("cum_neg")
    term = F.col("pos") * (below + F.col("neg") / F.lit(2.0))
    return rt.groupBy(*by).agg(F.try_divide(F.sum(term), F.first("tot_pos") * F.first("tot_neg")).alias("auc"))


def youden_threshold(scored: DataFrame, prob="prob", label="label", by: list[str] | None = None) -> DataFrame:
    """The threshold maximising tpr - fpr (ties: the highest threshold)."""
    by = list(by or [])
    pts = roc_curve(scored, prob, label, by).filter(F.col("threshold").isNotNull())
    j = F.col("tpr") - F.col("fpr")
    return pts.groupBy(*by).agg(F.max_by("threshold", F.struct(j, F.col("threshold"))).alias("threshold"),
                                F.max(j).alias("youden_j"))


def report_at_youden(scored: DataFrame, prob="prob", label="label") -> DataFrame:
    """E7 at the E6 threshold (the threshold is a one-row table, broadcast)."""
    th = youden_threshold(scored, prob, label).first()["threshold"]  # one scalar
    t = F.lit(th).cast("double")  # null for an empty table: the report has its classes with no rows
    return report_at(scored, t, prob, label).withColumn("threshold", t)


def uniform_bin(col, bins: int) -> Column:
    """0-based bin of a value in [0, 1] over ``bins`` uniform right-closed
    bins (the lowest also holds 0): number of inner edges ``i/bins`` below it."""
    c = _c(col)
    step = 1.0 / bins
    return sum((c > F.lit(i * step)).cast("int") for i in range(1, bins))


def calibration_curve(scored: DataFrame, prob="prob", label="label", bins: int = 10) -> DataFrame:
    """Per non-empty uniform bin: mean predicted probability, true rate, count."""
    b = scored.withColumn("bin", uniform_bin(prob, bins))
    return b.groupBy("bin").agg(F.avg(prob).alias("mean_prob"), F.avg(_c(label).cast("double")).alias("frac_pos"),
                                F.count(F.lit(1)).alias("n"))


def arange(start: float, stop: float, step: float) -> list[float]:
    """``numpy.arange`` values (start + i*step), exact to the last bit."""
    out, i = [], 0
    while start + i * step < stop:
        out.append(start + i * step)
        i += 1
    return out


def precision_at_thresholds(scored: DataFrame, thresholds: list[float] | None = None,
                            prob="prob", label="label") -> DataFrame:
    """Per threshold: precision of both classes and the counts behind them.

    One pass: every threshold contributes conditional counts to the same
    aggregate (no threshold x row expansion); the 1-row result is unpivoted.
    """
    ths = thresholds if thresholds is not None else arange(0.1, 1.0, 0.1)
    p, y = _c(prob), _c(label)
    aggs = [F.count(F.lit(1)).alias("n_total"), F.count_if(y == 1).alias("n1_actual")]
    for i, t in enumerate(ths):
        ge = p >= F.lit(float(t))
        aggs += [F.count_if(ge).alias(f"p1_{i}"), F.count_if(ge & (y == 1)).alias(f"tp_{i}"),
                 F.count_if(~ge & (y != 1)).alias(f"tn_{i}")]
    one = scored.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"p1_{i}").alias("n1_pred"),
                             F.col(f"tp_{i}").alias("tp"), F.col(f"tn_{i}").alias("tn"))
                    for i, t in enumerate(ths)])
    x = one.select("n_total", "n1_actual", F.explode(arr).alias("_t")).select("n_total", "n1_actual", "_t.*")
    return x.select(
        "threshold",
        _div0(F.col("tn"), F.col("n_total") - F.col("n1_pred")).alias("prec0"),
        _div0(F.col("tp"), F.col("n1_pred")).alias("prec1"),
        (F.col("n_total") - F.col("n1_actual")).alias("n0_actual"), "n1_actual",
        (F.col("n_total") - F.col("n1_pred")).alias("n0_pred"), "n1_pred", "n_total")


def threshold_slot(prob, ths: list[float]) -> Column:
    """Number of thresholds in the ascending, evenly spaced ``ths`` that are
    <= prob, from a closed-form guess corrected by exact comparisons."""
    steps = len(ths)
    t_arr = F.array(*[F.lit(float(t)) for t in ths])
    p = _c(prob)
    g = F.least(F.greatest(F.floor(p * F.lit(float(steps))).cast("int") + 1, F.lit(0)), F.lit(steps))
    down = F.when((g > 0) & (p < F.element_at(t_arr, F.greatest(g, F.lit(1)))), g - 1).otherwise(g)
    return F.when((down < steps) & (p >= F.element_at(t_arr, F.least(down + 1, F.lit(steps)))),
                  down + 1).otherwise(down)


def stratum_threshold_sweep(df: DataFrame, by: str, prob: str, label: str, steps: int = 100,
                            digits: int = 2) -> DataFrame:
    """Per stratum and threshold (numpy ``arange(0, 1, 1/steps)`` values):
    % of rows whose thresholded prediction equals the stratum's label.

    The data is read once into (stratum, threshold slot) counts; the sweep
    runs on at most strata x (steps+1) rows. The stratum label is its
    smallest label value (check Q4 that there is only one).
    """
    ths = arange(0.0, 1.0, 1.0 / steps)
    base = df.select(F.col(by).alias("stratum"), threshold_slot(prob, ths).alias("_slot"),
                     _c(label).alias("_y"))
    hist = base.groupBy("stratum", "_slot").agg(F.count(F.lit(1)).alias("_n"), F.min("_y").alias("_ymin"))
    lab = hist.groupBy("stratum").agg(F.min("_ymin").alias("stratum_label"), F.sum("_n").alias("n"))
    grid = lab.select("*", F.posexplode(F.array(*[F.lit(float(t)) for t in ths])).alias("i", "threshold"))
    j = grid.join(hist.select("stratum", "_slot", "_n"), "stratum").groupBy(
        "stratum", "threshold", "stratum_label", "n").agg(
        F.sum(F.when(F.col("_slot") >= F.col("i") + 1, F.col("_n")).otherwise(0)).alias("n_pred1"))
    correct = F.when(F.col("stratum_label") == 1, F.col("n_pred1")).otherwise(F.col("n") - F.col("n_pred1"))
    return j.select("stratum", "threshold", round_even(correct * F.lit(100.0) / F.col("n"), digits).alias("perf"))
