"""Numeric and date column functions.

Guards follow Spark's ANSI mode: a division by zero or a log of a
non-positive number gives NULL instead of raising or giving +-inf.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def round_even(col, d: int = 2) -> Column:
    """F16: numpy-style rounding (half to even on the binary value)."""
    scale = float(10 ** d)
    return F.rint(_c(col) * F.lit(scale)) / F.lit(scale)


def logit(p) -> Column:
    """ln(p/(1-p)); NULL for p outside (0, 1)."""
    p = _c(p)
    return F.when((p > 0) & (p < 1), F.ln(p / (F.lit(1.0) - p)))


def sigmoid(z, temperature: float | Column = 1.0) -> Column:
    """1/(1+exp(-z/T))."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z) / t))


def day_diff(end, start) -> Column:
    """whole days from ``start`` to ``end`` (negative values kept)."""
    return F.datediff(F.to_date(_c(end)), F.to_date(_c(start)))


def safe_ln(col) -> Column:
    """natural log, NULL for values <= 0."""
    c = _c(col)
    return F.when(c > 0, F.ln(c))


def safe_div(a, b) -> Column:
    """a / b with NULL for a zero or null divisor (``try_divide``)."""
    return F.try_divide(_c(a), _c(b))


def pct(a, b, d: int = 2) -> Column:
    """100 * a / b rounded half-even to ``d`` places; NULL when b is 0."""
    return round_even(F.try_divide(_c(a) * F.lit(100.0), _c(b)), d)


def vec_sub(a, b) -> Column:
    """element-wise difference of two equal-length arrays."""
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def vec_columns(col, n: int, prefix: str = "emb_dim_") -> list[Column]:
    """array elements as named columns ``prefix0..prefix{n-1}``."""
    return [_c(col)[i].alias(f"{prefix}{i}") for i in range(n)]


def md5_unit(*parts, digits: int = 8) -> Column:
    """A portable pseudo-random number in [0, 16**digits) from md5 of the parts (15 digits at most).

    The same md5 text is produced by every SQL engine, so seeded choices stay
    checkable against an oracle (``rand(seed)`` is not portable).
    """
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, digits), 16, 10).cast("bigint")
