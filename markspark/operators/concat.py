"""Concatenation of a key's texts that may outgrow one row (A2).

``stats.concat_text`` keeps a key's whole text in one buffer. Here the rows are
range-sorted by (key, order), running character counts give every text its
place in the key's whole text, and the texts that begin within the same
``chars`` characters become one numbered segment. A task holds a segment at a
time, so a key with a third of all rows is spread like any other rows, and the
segments depend on the rows alone, not on their partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markspark.operators.order import prefix_sums


def concat_segments(df: DataFrame, key: str, text: str, order: str | list[str], chars: int = 1 << 20, sep: str = " ",
                    out: str | None = None) -> DataFrame:
    """(key, segment, start, text): the texts of a key joined by ``sep`` in ``order``, as segments.

    ``start`` is the place of the segment's first character in the key's whole
    text; a segment's number is ``start // chars`` (a text longer than ``chars``
    leaves numbers out) and its length under ``chars`` plus its last text's.
    A key's segments in order, joined by ``sep``, are its whole text.

    A null text is left out and a key of null texts only has no segment; an
    empty text counts; a null key is a key; a null order comes first; rows equal
    in ``order`` are joined in the order of their texts; repeated rows are all
    joined; other columns are ignored; an empty table has no segment.
    """
    if chars < 1:
        raise ValueError("chars must be positive")
    orders = [order] if isinstance(order, str) else list(order)
    rows = df.filter(F.col(text).isNotNull()).select(
        F.col(key).alias("key"), *[F.col(o).alias(f"order_{i}") for i, o in enumerate(orders)], F.col(text).alias("text"))
    placed = prefix_sums(rows, [*[f"order_{i}" for i in range(len(orders))], "text"], {"chars": F.length("text") + F.lit(len(sep))},
                         ["key"], inclusive=False, with_totals=False)
    separator = sep.replace("\\", "\\\\").replace("'", "\\'")
    joined = F.expr(f"listagg(text, '{separator}') within group (order by cum_chars)")
    found = placed.groupBy("key", F.floor(F.col("cum_chars") / F.lit(chars)).cast("long").alias("segment")).agg(
        F.min("cum_chars").cast("long").alias("start"), joined.alias("joined"))
    return found.select(F.col("key").alias(key), "segment", "start", F.col("joined").alias(out or text))
