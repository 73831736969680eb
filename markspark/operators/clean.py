"""Projections, filters and row cleaning.

Every operator is DataFrame -> DataFrame and stays declarative, so Catalyst
pushes the predicates into the scan and prunes columns.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspark.functions.text import starts_with_trimmed, word_count


def year_between(df: DataFrame, col: str, lo: int, hi: int) -> DataFrame:
    """Rows whose date falls in years ``lo..hi`` inclusive.

    Written as a half-open range on the raw column (not ``year(col)``), so the
    Parquet reader gets both bounds as pushed filters. Null dates drop.
    """
    start = _dt.datetime(lo, 1, 1)
    end = _dt.datetime(hi + 1, 1, 1)
    c = F.col(col)
    return df.filter((c >= F.lit(start).cast(df.schema[col].dataType)) &
                     (c < F.lit(end).cast(df.schema[col].dataType)))


def drop_null(df: DataFrame, subset: list[str]) -> DataFrame:
    """Drop rows with a null (or NaN) in any listed column."""
    return df.dropna(how="any", subset=subset)


def drop_any_null(df: DataFrame) -> DataFrame:
    """Drop rows with a null (or NaN) anywhere."""
    return df.dropna(how="any")


def normalize_key(df: DataFrame, col: str, strict: bool = False) -> DataFrame:
    """Text key -> trimmed -> BIGINT; unparsable keys drop (or raise if strict)."""
    c = F.trim(F.col(col).cast("string"))
    parsed = c.cast("bigint") if strict else F.expr(f"try_cast(trim(cast(`{col}` as string)) as bigint)")
    return df.withColumn(col, parsed).dropna(subset=[col])


def select_like(df: DataFrame, needle: str, keys: list[str]) -> DataFrame:
    """P5: the key columns plus every column whose name contains ``needle``."""
    cols = list(keys) + [c for c in df.columns if needle in c and c not in keys]
    return df.select(*cols)


def drop_columns(df: DataFrame, cols: list[str], strict: bool = True) -> DataFrame:
    """Drop listed columns; ``strict`` raises on a missing one like pandas."""
    if strict:
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise KeyError(f"columns not found: {missing}")
    return df.drop(*cols)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename columns."""
    return df.withColumnsRenamed(mapping)


def mark_length_filter(df: DataFrame, col: str, lo: int = 1, hi: int = 4,
                       length_col: str = "mark_len", filter: bool = True) -> DataFrame:
    """Word-count column, optionally keeping only ``lo..hi`` words.

    ``filter=False`` keeps every row (the column is still added).
    """
    out = df.withColumn(length_col, word_count(F.col(col)))
    return out.filter(F.col(length_col).between(lo, hi)) if filter else out


def exclude_codes(df: DataFrame, col: str, codes: list[str], cast_to: str = "int") -> DataFrame:
    """Drop listed codes, cast the rest; a code that does not parse drops."""
    kept = df.filter(~F.col(col).isin(list(codes)) | F.col(col).isNull())
    return kept.withColumn(col, F.expr(f"try_cast(`{col}` as {cast_to})")).dropna(subset=[col])


def split_by_prefix(df: DataFrame, col: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """P10: rows whose trimmed code starts with ``prefix``, and all the others.

    A null code belongs to the second table.
    """
    m = starts_with_trimmed(F.col(col), prefix)
    return df.filter(m), df.filter(~m)


def time_split(df: DataFrame, col: str, train_end: str, val_end: str,
               test_end: str | None = None, split_col: str = "split") -> DataFrame:
    """Label each row train / val / test by date bounds (inclusive ends).

    One conditional column, not three scans. Rows after ``test_end`` (if
    given) or with a null date get a null split.
    """
    d = F.to_date(F.col(col))
    test = d > F.lit(val_end).cast("date")
    if test_end is not None:
        test = test & (d <= F.lit(test_end).cast("date"))
    s = (F.when(d <= F.lit(train_end).cast("date"), "train")
         .when(d <= F.lit(val_end).cast("date"), "val")
         .when(test, "test"))
    return df.withColumn(split_col, s)


def row_filter(df: DataFrame, condition: Column | str) -> DataFrame:
    """Plain equality / range / threshold filter."""
    return df.filter(condition)


def correct_only(scored: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Keep correctly predicted rows."""
    return scored.filter(F.col(label) == F.col(pred))


def override(df: DataFrame, key: str, col: str, mapping: dict) -> DataFrame:
    """Set ``col`` to a new value for listed key values.

    A handful of keys becomes one CASE expression; a large mapping should be
    a table joined on the key (see joins.left_lookup).
    """
    expr = None
    for k, v in mapping.items():
        expr = (F.when(F.col(key) == F.lit(k), F.lit(v)) if expr is None
                else expr.when(F.col(key) == F.lit(k), F.lit(v)))
    return df if expr is None else df.withColumn(col, expr.otherwise(F.col(col)))


def latest_per_key(df: DataFrame, key: str, date_col: str, tie: str | list[str]) -> DataFrame:
    """One row per ``key``: the latest ``date_col``; a null date counts as latest.

    Uses ``max_by`` in a hash aggregate (partial aggregation on the map side,
    no sort, no window): a hot key with a third of the rows is reduced
    before the shuffle. ``tie`` breaks equal dates (the highest wins).
    """
    ties = [tie] if isinstance(tie, str) else list(tie)
    rank = F.struct(F.col(date_col).isNull().alias("_n"), F.col(date_col).alias("_d"),
                    *[F.col(t).alias(f"_t{i}") for i, t in enumerate(ties)])
    others = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*[F.col(c) for c in others]), rank).alias("_best")
    return df.groupBy(key).agg(best).select(key, "_best.*").select(*df.columns)
