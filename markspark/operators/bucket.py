"""Binning and normalisation.

Bin edges are either fixed (a literal CASE expression), or derived from one
small aggregate (min/max, quantile edges) whose few values are read back as
literals: no global window, no join back to the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspark.operators.order import exact_quantiles

# The two interval edge lists used to stratify correct
# predictions by probability (27 and 23 right-closed intervals).
EDGES_27 = [0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.1, 0.15, 0.20, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5,
            0.55, 0.60, 0.65, 0.70, 0.75, 0.8, 0.85, 0.9, 0.95, 0.96, 0.97, 0.98, 1]
EDGES_23 = [0, 0.05, 0.1, 0.15, 0.20, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.60, 0.65, 0.70,
            0.75, 0.8, 0.85, 0.9, 0.95, 0.96, 0.97, 0.98, 1]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def cut(df: DataFrame, col: str, edges: list[float], prefix: str = "bin",
        include_lowest: bool = False) -> DataFrame:
    """Right-closed intervals ``(e[i], e[i+1]]``: adds ``<prefix>`` (1-based),
    ``<prefix>_lo`` and ``<prefix>_hi``. Values outside are NULL."""
    c = _c(col)
    expr = None
    for i in range(len(edges) - 1):
        lo, hi = float(edges[i]), float(edges[i + 1])
        cond = ((c >= F.lit(lo)) if (include_lowest and i == 0) else (c > F.lit(lo))) & (c <= F.lit(hi))
        expr = F.when(cond, F.lit(i + 1)) if expr is None else expr.when(cond, F.lit(i + 1))
    lo_arr = F.array(*[F.lit(float(e)) for e in edges[:-1]])
    hi_arr = F.array(*[F.lit(float(e)) for e in edges[1:]])
    out = df.withColumn(prefix, expr)
    return (out.withColumn(f"{prefix}_lo", F.try_element_at(lo_arr, F.col(prefix)))
               .withColumn(f"{prefix}_hi", F.try_element_at(hi_arr, F.col(prefix))))


def quantile_edges(df: DataFrame, col: str, qs: list[float], approx: bool = False,
                   accuracy: int = 10000) -> list[float]:
    """Distinct quantile edges (duplicates dropped, ascending).

    Exact (sort-based, interpolated) by default; ``approx=True`` uses one
    ``percentile_approx`` aggregate (no sort, bounded memory, rank error
    1/accuracy, no interpolation) for very large inputs.
    """
    if approx:
        arr = F.array(*[F.lit(float(q)) for q in qs])
        row = df.agg(F.percentile_approx(F.col(col).cast("double"), arr, accuracy).alias("_q")).first()
    else:
        row = exact_quantiles(df, col, qs).first()
    vals = [] if row is None else [v for v in row["_q"] if v is not None]
    out: list[float] = []
    for v in vals:
        if not out or v != out[-1]:
            out.append(float(v))
    return out


def qcut(df: DataFrame, col: str, qs: list[float], prefix: str = "qbin", approx: bool = False) -> DataFrame:
    """Quantile bins with duplicate edges dropped; the first bin includes its
    lower edge."""
    edges = quantile_edges(df, col, qs, approx)
    if len(edges) < 2:
        return df.withColumn(prefix, F.lit(None).cast("int")) \
                 .withColumn(f"{prefix}_lo", F.lit(None).cast("double")) \
                 .withColumn(f"{prefix}_hi", F.lit(None).cast("double"))
    return cut(df, col, edges, prefix, include_lowest=True)


def qcut_mean(df: DataFrame, col: str, qs: list[float], vals: list[str], prefix: str = "qbin") -> DataFrame:
    """Mean of ``vals`` per quantile bin of ``col``."""
    b = qcut(df, col, qs, prefix)
    return b.groupBy(prefix, f"{prefix}_lo", f"{prefix}_hi").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in vals])


def histogram(df: DataFrame, col: str, bins: int | None = None, width: float | None = None,
              normalize: bool = False) -> DataFrame:
    """Equal-width histogram over [min, max] with ``bins`` bins, or
    ``int((max - min) / width)`` bins; the maximum falls in the last bin.
    Output: bin (0-based), lo, hi, n (and share when ``normalize``)."""
    df = df.filter(~F.isnan(F.col(col).cast("double")))  # NaN is missing, like null
    mm = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"),
                F.count(col).alias("n")).first()
    lo, hi, total = mm["lo"], mm["hi"], mm["n"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n bigint" +
                                               (", share double" if normalize else ""))
    if bins is None:
        bins = max(int((hi - lo) / float(width)), 1)
    span = hi - lo
    c = F.col(col).cast("double")
    raw = F.floor((c - F.lit(lo)) * F.lit(float(bins)) / F.lit(span)).cast("int") if span > 0 else F.lit(0)
    b = F.least(raw, F.lit(bins - 1))
    g = df.filter(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    step = span / bins
    g = g.withColumn("lo", F.lit(lo) + F.col("bin") * F.lit(step)).withColumn("hi", F.lit(lo) + (F.col("bin") + 1) * F.lit(step))
    cols = ["bin", "lo", "hi", "n"]
    if normalize:
        g = g.withColumn("share", F.col("n") / F.lit(float(total)))
        cols.append("share")
    return g.select(*cols)


def scale_stats(df: DataFrame, cols: list[str]):
    """Minimum, maximum, mean and sample std of every column, as one row: one pass for both :func:`minmax` and :func:`zscore`."""
    return df.agg(*[f(c).alias(f"{c}__{k}") for c in cols
                    for k, f in (("lo", F.min), ("hi", F.max), ("m", F.avg), ("s", F.stddev_samp))]).first()


def minmax(df: DataFrame, cols: list[str], suffix: str = "_norm", found=None) -> DataFrame:
    """(x - min) / (max - min) per column; a constant column gives NULL. ``found``: the columns' :func:`scale_stats`."""
    r = found or scale_stats(df, cols)
    out = df
    for c in cols:
        lo, hi = r[f"{c}__lo"], r[f"{c}__hi"]
        out = out.withColumn(c + suffix, F.try_divide(F.col(c) - F.lit(lo), F.lit(hi) - F.lit(lo)).cast("double"))
    return out


def zscore(df: DataFrame, cols: list[str], suffix: str = "_std", found=None) -> DataFrame:
    """(x - mean) / sample std per column. ``found``: the columns' :func:`scale_stats`."""
    r = found or scale_stats(df, cols)
    out = df
    for c in cols:
        out = out.withColumn(c + suffix, F.try_divide(F.col(c) - F.lit(r[f"{c}__m"]), F.lit(r[f"{c}__s"])))
    return out
