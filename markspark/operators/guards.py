"""Guards in flight (Q1, Q2, J3, J5): a lookup is checked by the job that writes it.

Rows are counted on their way into the join and out of it (``DataFrame.observe``),
so the check costs no second job. A left lookup that returns as many rows as it
was given has lost none and has met no repeated key. The result is written below
a version folder and becomes visible, by a commit marker, only if the guard holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from markspark.operators.report import publish


class GuardFailed(ValueError):
    """A guarded table was not published."""


@dataclass
class Guard:
    """What a guarded write has counted."""

    rows_in: int
    rows_out: int
    matched: int

    @property
    def holds(self) -> bool:
        return self.rows_in == self.rows_out


def guarded_lookup(df: DataFrame, lookup: DataFrame, on: list[str], path: str, expect_n: int | None = None,
                   raise_on_fail: bool = True) -> Guard:
    """Publish ``df`` left-joined to ``lookup`` as the table ``rows`` below ``path`` (see :func:`report.publish`), if
    every row of ``df`` comes out exactly once (and there are ``expect_n``).

    A null key matches nothing and its row is kept. When the guard fails nothing is published and :class:`GuardFailed` is
    raised, or (``raise_on_fail=False``) the counts are returned."""
    before, after = Observation(), Observation()
    found = "_looked_up"
    joined = df.observe(before, F.count(F.lit(1)).alias("n")).join(lookup.withColumn(found, F.lit(1)), on, "left")
    out = joined.observe(after, F.count(F.lit(1)).alias("n"), F.count(found).alias("matched")).drop(found)
    counts: list[Guard] = []

    def check() -> None:
        guard = Guard(before.get["n"], after.get["n"], after.get["matched"])
        counts.append(guard)
        if not guard.holds or (expect_n is not None and guard.rows_out != expect_n):
            raise GuardFailed(f"{guard.rows_in} rows went in, {guard.rows_out} came out" +
                              (f", {expect_n} were expected" if expect_n is not None else ""))

    try:
        publish({"rows": out}, path, check)
    except GuardFailed:
        if raise_on_fail:
            raise
    return counts[0]
