"""Small builders shared by the oracle SQL strings."""

from __future__ import annotations

from pyspark.sql import Column

from markspark.functions.numeric import round_even

SCORE_KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
# decimals kept for aggregated doubles (sums/means differ in the last bits
# between engines; rounding both sides keeps the comparison exact)
DIGITS = 9


def dbl(x: float) -> str:
    """A double literal that parses to exactly ``x``."""
    return f"cast('{float(x)!r}' as double)"


# Aggregated doubles are rounded in two steps: to 12 places first, which maps
# the last-bit differences of another summation order to the same double,
# then to the reported places (a value that is exactly half-way at the
# reported places would otherwise round either way depending on that noise).
GUARD = 12


def r9(expr: str, d: int = DIGITS) -> str:
    return f"round_even(round_even(({expr})::double, {GUARD}), {d})"


def sr9(col: Column, d: int = DIGITS) -> Column:
    return round_even(round_even(col, GUARD), d)


def dlist(xs) -> str:
    """A DuckDB list literal of exact doubles."""
    return "[" + ", ".join(dbl(x) for x in xs) + "]"


def report_sql(counts: str, by: list[str] | None = None) -> str:
    """SQL twin of evaluate.report_from_counts over a CTE ``counts`` with
    tp, tn, fp, fn, n (and ``by`` columns)."""
    b = "".join(f"{c}, " for c in (by or []))
    d0 = "coalesce(({a})::double / nullif(({b})::double, 0), 0.0)"
    p1, r1 = d0.format(a="tp", b="tp + fp"), d0.format(a="tp", b="tp + fn")
    p0, r0 = d0.format(a="tn", b="tn + fn"), d0.format(a="tn", b="tn + fp")
    m = (f"(select {b}tp, tn, fp, fn, n, {p1} as p1, {r1} as r1, {p0} as p0, {r0} as r0, "
         f"tp + fn as s1, tn + fp as s0 from {counts})")
    f = "coalesce((2.0::double * {p} * {r}) / nullif({p} + {r}, 0), 0.0)"
    mm = (f"(select *, {f.format(p='p1', r='r1')} as f1_1, {f.format(p='p0', r='r0')} as f1_0 from {m} m0)")
    w = "(({a}) * s0 + ({c}) * s1) / n"
    rows = [
        ("'0'", "p0", "r0", "f1_0", "s0"),
        ("'1'", "p1", "r1", "f1_1", "s1"),
        ("'accuracy'", "null::double", "null::double", d0.format(a="tp + tn", b="n"), "n"),
        ("'macro avg'", "(p0 + p1) / 2", "(r0 + r1) / 2", "(f1_0 + f1_1) / 2", "n"),
        ("'weighted avg'", w.format(a="p0", c="p1"), w.format(a="r0", c="r1"), w.format(a="f1_0", c="f1_1"), "n"),
    ]
    parts = [f"select {b}{k} as class_name, {p} as precision, {r} as recall, {f1} as f1, cast({s} as bigint) as support "
             f"from {mm} mm" for k, p, r, f1, s in rows]
    return "\nunion all\n".join(parts)


def counts_sql(src: str, label: str = "label", pred: str = "pred", by: list[str] | None = None) -> str:
    b = ", ".join(by or [])
    sel = f"{b}, " if b else ""
    grp = f" group by {b}" if b else ""
    return (f"select {sel}cast(count_if({label} = 1 and {pred} = 1) as bigint) as tp, "
            f"cast(count_if({label} = 0 and {pred} = 0) as bigint) as tn, "
            f"cast(count_if({label} = 0 and {pred} = 1) as bigint) as fp, "
            f"cast(count_if({label} = 1 and {pred} = 0) as bigint) as fn, count(*) as n from {src}{grp}")


def roc_sql(src: str, prob: str = "prob", label: str = "label", by: list[str] | None = None) -> str:
    """Per distinct score: pos, neg, cumulative (descending) and totals."""
    b = ", ".join(by or [])
    sel = f"{b}, " if b else ""
    part = f"partition by {b} " if b else ""
    w = f"over ({part}order by score desc rows between unbounded preceding and current row)"
    t = f"over ({part.strip()})"
    return f"""select *, sum(pos) {w} as cum_pos, sum(neg) {w} as cum_neg,
  sum(pos) {t} as tot_pos, sum(neg) {t} as tot_neg
from (select {sel}{prob} as score, count_if({label} = 1) as pos, count_if({label} <> 1) as neg
      from {src} group by {sel}{prob}) st"""
