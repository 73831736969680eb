"""Quality checks (Q1-Q5) as table operators.

Each check is a single aggregate returning one row ``(check, failures, ok)``;
``raise_on_fail`` turns it into an assertion. Only the one-row result ever
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _result(df: DataFrame, name: str, failures, raise_on_fail: bool) -> DataFrame:
    out = df.agg(failures.cast("bigint").alias("failures")).select(
        F.lit(name).alias("check_name"), "failures", (F.col("failures") == 0).alias("ok"))
    if raise_on_fail:
        row = out.first()
        if not row["ok"]:
            raise AssertionError(f"check {name} failed: {row['failures']} failures")
    return out


def expect_rows(df: DataFrame, n: int, raise_on_fail: bool = False) -> DataFrame:
    """Q1: row count equals ``n`` (failures = |count - n|)."""
    return _result(df, "expect_rows", F.abs(F.count(F.lit(1)) - F.lit(n)), raise_on_fail)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def expect_unique(df: DataFrame, keys: list[str], raise_on_fail: bool = False) -> DataFrame:
    """Q2: the key is unique (failures = number of duplicated keys)."""
    return _result(duplicate_keys(df, keys), "expect_unique", F.count(F.lit(1)), raise_on_fail)


def expect_equal_columns(df: DataFrame, a: str, b: str, raise_on_fail: bool = False) -> DataFrame:
    """Q3: two columns agree on every row (null-safe)."""
    return _result(df, "expect_equal_columns", F.count_if(~F.col(a).eqNullSafe(F.col(b))), raise_on_fail)


def expect_single_value(df: DataFrame, by: list[str], col: str, raise_on_fail: bool = False) -> DataFrame:
    """Q4: one distinct ``col`` value per group (failures = groups with more)."""
    g = df.groupBy(*by).agg(F.count_distinct(col).alias("_k"))
    return _result(g, "expect_single_value", F.count_if(F.col("_k") > 1), raise_on_fail)


def expect_full_alignment(counts: DataFrame, a: str, b: str, raise_on_fail: bool = False) -> DataFrame:
    """Q5: per-document word count equals score count."""
    return _result(counts, "expect_full_alignment", F.count_if(~F.col(a).eqNullSafe(F.col(b))), raise_on_fail)
