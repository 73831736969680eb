"""Aggregations.

All are hash aggregates with a partial (map-side) and a final stage, so a
hot group is pre-reduced on every executor before the shuffle. Ratios use
``try_divide`` (NULL on 0/0) and numpy-style rounding where the reference
rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markspark.functions.numeric import round_even
from markspark.operators.joins import semi


def exactly_one(df: DataFrame, key: str, col: str) -> DataFrame:
    """A1: rows of ``df`` whose key has exactly one non-null ``col`` value row."""
    ones = df.groupBy(key).agg(F.count(col).alias("_n")).filter("_n = 1").select(key)
    return semi(df, ones, key)


def concat_text(df: DataFrame, key: str, text: str, order: str | list[str],
                out: str | None = None, sep: str = " ") -> DataFrame:
    """A2: one row per key with its texts joined by ``sep`` in ``order``.

    ``listagg ... within group`` sorts inside each group after a shuffle on
    the key; a null text is dropped from the join.
    """
    orders = [order] if isinstance(order, str) else list(order)
    out = out or text
    ob = ", ".join(f"`{o}`" for o in orders)
    agg = F.expr(f"listagg(`{text}`, '{sep}') within group (order by {ob})").alias(out)
    return df.groupBy(key).agg(agg)


def concat_texts(df: DataFrame, key: str, texts: dict[str, str], order: str | list[str],
                 sep: str = " ") -> DataFrame:
    """A2 for several text columns at once: ``{out: text}`` concatenated per key
    in one aggregate (one shuffle instead of one per column plus joins)."""
    orders = [order] if isinstance(order, str) else list(order)
    ob = ", ".join(f"`{o}`" for o in orders)
    aggs = [F.expr(f"listagg(`{t}`, '{sep}') within group (order by {ob})").alias(o) for o, t in texts.items()]
    return df.groupBy(key).agg(*aggs)


def value_counts(df: DataFrame, col: str, normalize: bool = True, out: str = "pct") -> DataFrame:
    """A3: frequency table, as a percentage of all rows when ``normalize``."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    if not normalize:
        return counts
    total = counts.agg(F.sum("n")).first()[0] or 0  # one scalar from the small table
    return counts.withColumn(out, F.try_divide(F.col("n") * F.lit(100.0), F.lit(float(total))))


def incidence_rate(df: DataFrame, label: str, by: list[str] | None = None, out: str = "incidence") -> DataFrame:
    """A4: 100 * mean of a 0/1 label (per group when ``by``)."""
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(label).cast("bigint").alias("n_pos"),
            (F.lit(100.0) * F.sum(label) / F.count(F.lit(1))).alias(out)]
    return df.groupBy(*(by or [])).agg(*aggs)


def match_rate(df: DataFrame, col: str, out: str = "match_pct") -> DataFrame:
    """A5: percentage of rows with a non-null ``col``, rounded to 2 places."""
    return df.agg(round_even(F.lit(100.0) * F.count(col) / F.count(F.lit(1)), 2).alias(out))


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row with the null count of each column (long form: column, nulls)."""
    cols = cols or df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack}) as (column_name, null_count)")


def distinct_profile(df: DataFrame, keys: list[str]) -> DataFrame:
    """Row count, distinct rows and distinct keys in one job."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_distinct(*[F.col(c) for c in df.columns]).alias("n_distinct_rows"),
                  F.count_distinct(*[F.col(k) for k in keys]).alias("n_distinct_keys"))


def range_profile(df: DataFrame, col: str) -> DataFrame:
    """Min, max and row count of a date column."""
    return df.agg(F.min(col).alias("min_value"), F.max(col).alias("max_value"),
                  F.count(F.lit(1)).alias("n_rows"))


def group_count(df: DataFrame, by: list[str], col: str | None = None, out: str = "n") -> DataFrame:
    """Rows (or non-null ``col`` values) per group."""
    c = F.count(col) if col else F.count(F.lit(1))
    return df.groupBy(*by).agg(c.alias(out))


def group_stats(df: DataFrame, by: list[str], val: str) -> DataFrame:
    """A10: mean and sample standard deviation per group."""
    return df.groupBy(*by).agg(F.avg(val).alias("mean"), F.stddev_samp(val).alias("std"))


def box_stats(df: DataFrame, by: list[str], val: str) -> DataFrame:
    """Five-number summary per group with 1.5 IQR whisker limits.

    Quantiles come from :func:`exact_quantiles` (sort-based, so a group with
    a third of all rows is still split across tasks).
    """
    from markspark.operators.order import exact_quantiles
    q = exact_quantiles(df, val, [0.0, 0.25, 0.5, 0.75, 1.0], by)
    n = df.groupBy(*by).agg(F.count(val).alias("n"))
    g = q.join(n, on=by, how="inner") if by else q.join(n, how="inner")
    iqr = F.col("_q")[3] - F.col("_q")[1]
    return g.select(*by, "n", F.col("_q")[0].alias("min"), F.col("_q")[1].alias("q1"),
                    F.col("_q")[2].alias("median"), F.col("_q")[3].alias("q3"),
                    F.col("_q")[4].alias("max"),
                    (F.col("_q")[1] - F.lit(1.5) * iqr).alias("whisker_lo"),
                    (F.col("_q")[3] + F.lit(1.5) * iqr).alias("whisker_hi"))


def unpivot(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Long form (by..., metric, value) of numeric columns (``stack``)."""
    by = list(by or [])
    stack = ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols)
    return df.selectExpr(*[f"`{b}`" for b in by], f"stack({len(cols)}, {stack}) as (metric, value)")


def describe(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Count, mean, std, min, quartiles, max per column (one row per
    metric). Quartiles are exact and sort-based (see order.exact_quantiles)."""
    from markspark.operators.order import exact_quantiles
    keys = list(by or []) + ["metric"]
    long = unpivot(df, cols, by)
    a = long.groupBy(*keys).agg(F.count("value").alias("count"), F.avg("value").alias("mean"),
                                F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                                F.max("value").alias("max"))
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], keys)
    return a.join(q, keys).select(*keys, "count", "mean", "std", "min", F.col("_q")[0].alias("p25"),
                                  F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p75"), "max")


def quantiles(df: DataFrame, cols: list[str], qs: list[float], by: list[str] | None = None,
              digits: int | None = 4) -> DataFrame:
    """Interpolated quantiles, long form (by..., metric, q, value),
    rounded half-even to ``digits`` places."""
    from markspark.operators.order import exact_quantiles
    keys = list(by or []) + ["metric"]
    q = exact_quantiles(unpivot(df, cols, by), "value", qs, keys)
    arr = F.array(*[F.lit(float(x)) for x in qs])
    z = q.select(*keys, F.explode(F.arrays_zip(arr.alias("q"), F.col("_q").alias("v"))).alias("_z"))
    val = F.col("_z.v")
    return z.select(*keys, F.col("_z.q").alias("q"), (round_even(val, digits) if digits is not None else val).alias("value"))


def mean_ci(df: DataFrame, by: list[str] | None, val: str, z: float = 1.96) -> DataFrame:
    """Mean with a normal confidence band ``mean -+ z*s/sqrt(n)``."""
    g = df.groupBy(*(by or [])).agg(F.count(val).alias("n"), F.avg(val).alias("mean"),
                                    F.stddev_samp(val).alias("std"))
    half = F.lit(float(z)) * F.col("std") / F.sqrt(F.col("n"))
    return g.withColumn("ci_lo", F.col("mean") - half).withColumn("ci_hi", F.col("mean") + half)


def word_attribution_mean(attr: DataFrame, by: list[str], word: str = "word", score: str = "score") -> DataFrame:
    """Mean score and frequency of each word per group (e.g. class)."""
    return attr.groupBy(*by, word).agg(F.avg(score).alias("attr"), F.count(F.lit(1)).alias("freq"))


def mean_by(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mean of ``y`` per ``x`` with the A14 band."""
    return mean_ci(df, [x], y)


def reg_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """M8: least-squares slope and intercept of ``y`` on ``x`` (one aggregate)."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                  F.regr_count(y, x).alias("n"))
