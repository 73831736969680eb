"""Temperature scaling.

The loss ``mean BCE(z / T, y)`` is convex in beta = 1/T, so Newton's method
on beta converges in a few damped steps; each is one aggregate over a cached
table of (logit, label, count), and only three numbers travel to the driver.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markspark.functions.numeric import logit, sigmoid


def _softplus(x: Column) -> Column:
    """log(1 + exp(x)), stable for large |x|."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def bce_with_logits(x: Column, y: Column) -> Column:
    """Per-row binary cross-entropy of logit ``x`` against label ``y``."""
    return _softplus(x) - x * y.cast("double")


def logits_table(scored: DataFrame, prob: str = "prob", label: str = "label") -> DataFrame:
    """(z, y): logit of the probability and the label; p in {0, 1} is dropped."""
    return scored.select(logit(prob).alias("z"), F.col(label).cast("double").alias("y")).filter("z is not null")


def temperature_grid(scored: DataFrame, grid: list[float], prob: str = "prob", label: str = "label") -> DataFrame:
    """Mean BCE loss of ``logit(prob) / T`` for every T of the grid, one pass."""
    zt = logits_table(scored, prob, label)
    aggs = [F.avg(bce_with_logits(F.col("z") / F.lit(float(t)), F.col("y"))).alias(f"l{i}") for i, t in enumerate(grid)]
    one = zt.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(float(t)).alias("temperature"), F.col(f"l{i}").alias("loss")) for i, t in enumerate(grid)])
    return one.select(F.explode(arr).alias("_g")).select("_g.*")


def fit_temperature(scored: DataFrame, prob: str = "prob", label: str = "label", logit_1: str = "logit_1",
                    max_iter: int = 50, tol: float = 1e-10) -> dict:
    """The temperature minimising mean BCE(logit / T, label).

    The logit is the stored ``logit_1`` where there is one (finite for every
    row), else that of ``prob``. Rows are counted per (logit, label) once; each
    Newton step on beta = 1/T is halved until beta stays positive and the loss
    falls, so confident wrong scores (whose best beta is near 0) end at a small
    positive beta instead of diverging.

    Returns ``{"temperature", "beta", "iterations", "loss", "converged"}``; all
    None / False for an empty table.
    """
    if logit_1 in scored.columns:
        rows = scored.select(F.col(logit_1).cast("double").alias("z"), F.col(label).cast("double").alias("y")).dropna()
    else:
        rows = logits_table(scored, prob, label)
    zt = rows.groupBy("z", "y").agg(F.count(F.lit(1)).alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    n, z, y = F.col("n"), F.col("z"), F.col("y")

    def at(beta: float):
        x = F.lit(beta) * z
        s = sigmoid(x)
        return zt.agg((F.sum(n * bce_with_logits(x, y)) / F.sum(n)).alias("loss"),
                      (F.sum(n * (s - y) * z) / F.sum(n)).alias("g"),
                      (F.sum(n * s * (F.lit(1.0) - s) * z * z) / F.sum(n)).alias("h")).first()

    beta, it, converged = 1.0, 0, False
    try:
        now = at(beta)
        if now["loss"] is None:
            return {"temperature": None, "beta": None, "iterations": 0, "loss": None, "converged": False}
        for it in range(1, max_iter + 1):
            step = now["g"] / now["h"] if now["h"] else now["g"]
            new, after, share = beta, now, 1.0
            while share > 1e-9:
                tried = beta - share * step
                if tried > 0:
                    got = at(tried)
                    if got["loss"] <= now["loss"] - 1e-4 * share * step * now["g"]:
                        new, after = tried, got
                        break
                share /= 2
            moved, beta, now = abs(new - beta), new, after
            if moved < tol * max(1.0, abs(beta)):
                converged = abs(now["g"]) < 1e-6
                break
    finally:
        zt.unpersist()
    return {"temperature": 1.0 / beta, "beta": beta, "iterations": it, "loss": now["loss"], "converged": converged}


def fit_temperature_df(scored: DataFrame, prob: str = "prob", label: str = "label") -> DataFrame:
    """E10 as a one-row table (temperature, iterations, loss, converged)."""
    r = fit_temperature(scored, prob, label)
    spark: SparkSession = scored.sparkSession
    return spark.createDataFrame([(r["temperature"], int(r["iterations"]), r["loss"], r["converged"])],
                                 "temperature double, iterations int, loss double, converged boolean")


def apply_temperature(scored: DataFrame, temperature: float, logit_1: str = "logit_1",
                      out: str = "prob_t") -> DataFrame:
    """Probability from the temperature-scaled logit (argmax is unchanged)."""
    return scored.withColumn(out, sigmoid(F.col(logit_1), float(temperature)))
