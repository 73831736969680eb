"""Seeded, portable sampling.

Every random choice is md5(seed | key): the same rows are chosen on every
run, on every cluster size, and by the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspark.operators.selection import first_by_hash


def seeded_key(seed: int, key: list[str]) -> Column:
    """md5 of ``seed|key...`` as hex text (orders rows pseudo-randomly)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def sample_per_group(df: DataFrame, by: list[str], n: int, seed: int, key: list[str],
                     strict: bool = False, tie: list[str] | None = None) -> DataFrame:
    """``n`` rows per group without replacement (the n smallest md5 keys).

    One path for every ``n``: radix selection on the hashes finds each group's
    cut, one filter keeps the rows; a hot group is only counted, a null group is
    a group. ``strict`` raises when a group has fewer than ``n`` rows; ``tie``
    orders rows whose key repeats.
    """
    out = first_by_hash(df, by, n, seeded_key(seed, key), list(dict.fromkeys([*key, *(tie or [])])))
    if strict:
        short = df.groupBy(*by).count().filter(F.col("count") < n).limit(1).count()
        if short:
            raise ValueError(f"a group has fewer than {n} rows")
    return out


def balanced_sample(df: DataFrame, by: list[str], seed: int, key: list[str]) -> DataFrame:
    """Every group cut to the size of the smallest group, in one pass."""
    m = df.groupBy(*by).count().agg(F.min("count")).first()[0] or 0
    return sample_per_group(df, by, int(m), seed, key)


def shuffle(df: DataFrame, seed: int, key: list[str]) -> DataFrame:
    """All rows in a seeded pseudo-random order (for output only)."""
    return df.orderBy(seeded_key(seed, key), *[F.col(k) for k in key])
