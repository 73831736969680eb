"""Labelling and decision columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspark.functions.text import norm_eq


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_present(col) -> Column:
    """L2: 1 when the value is not null, else 0."""
    return _c(col).isNotNull().cast("int")


def distinct_rule(pub="pub_ind", acq="acq_dist_in", supp="supp_reg_in",
                  descriptive="descriptive_sum", generic="generic_sum") -> Column:
    """L1 as one expression.

    The ordered, overwriting rule list (start at -1; published without
    acquired distinctiveness -> 1; unpublished with no office action and
    no supplemental register -> 1; published with acquired distinctiveness
    -> 0; unpublished with an office action -> 0; supplemental register -> 0;
    what is left -> 0) reduces to: 1 iff not on the supplemental register and
    one of the two "1" rules holds. A null compares unequal to every value,
    so it never satisfies an equality rule.
    """
    p, a, s, d, g = (_c(x) for x in (pub, acq, supp, descriptive, generic))
    rule_1a = (p == 1) & (a == 0)
    rule_1b = (p == 0) & (g == 0) & (d == 0) & (s == 0)
    not_supp = ~F.coalesce(s == 1, F.lit(False))
    return F.when(F.coalesce(not_supp & (rule_1a | rule_1b), F.lit(False)), 1).otherwise(0).cast("int")


def label_trace(pub="pub_ind", acq="acq_dist_in", supp="supp_reg_in",
                descriptive="descriptive_sum", generic="generic_sum") -> Column:
    """L1 before the final ``-1 -> 0`` step (the intermediate incidence print).

    A null office-action sum counts as "not equal to 0", like NaN in pandas.
    """
    p, a, s, d, g = (_c(x) for x in (pub, acq, supp, descriptive, generic))
    t = lambda e: F.coalesce(e, F.lit(False))
    return (F.when(t(s == 1), 0)
            .when(t(p == 0) & (F.coalesce(g, F.lit(1)) != 0), 0)
            .when(t(p == 0) & (F.coalesce(d, F.lit(1)) != 0), 0)
            .when(t(p == 1) & t(a == 1), 0)
            .when(t(p == 0) & t(g == 0) & t(d == 0) & t(s == 0), 1)
            .when(t(p == 1) & t(a == 0), 1)
            .otherwise(-1).cast("int"))


def label_distinct(cases: DataFrame, office_actions: DataFrame, key: str = "serial_no",
                   pub_date: str = "publication_dt", out: str = "distinct_ind") -> DataFrame:
    """L1+L2+J3: left-join office-action sums, add ``pub_ind`` and the label."""
    j = cases.withColumn("pub_ind", is_present(pub_date)).join(office_actions, on=key, how="left")
    return j.withColumn(out, distinct_rule())


def translation_text(mark="mark_processed", final="mark_final") -> tuple[Column, Column]:
    """L3: (translated_ind as double, text) from a mark and its final form."""
    differs = ~norm_eq(mark, final)
    ind = differs.cast("double")
    text = F.when(differs, _c(final)).otherwise(F.lit("no translation required"))
    return ind, text


# The class words tested in priority order, each with the
# label it gives (two spellings map to "suggestive").
MARK_TYPE_RULES = [
    ("arbitrary", "arbitrary"),
    ("fanciful", "fanciful"),
    ("suggestive", "suggestive"),
    ("suggesitve", "suggestive"),
    ("descriptive", "descriptive"),
    ("generic", "generic"),
]


def mark_type(col) -> Column:
    """L4: case-sensitive substring classifier; first match wins, else 'none'."""
    c = _c(col)
    expr = None
    for needle, label in MARK_TYPE_RULES:
        cond = F.coalesce(c.contains(needle), F.lit(False))
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise("none")


def predict_threshold(prob="prob", th: float = 0.5) -> Column:
    """1 when prob >= th."""
    return (_c(prob) >= F.lit(float(th))).cast("int")


def predict_argmax(logit_0="logit_0", logit_1="logit_1") -> Column:
    """Argmax of two logits (ties go to class 0, as argmax picks the first)."""
    return (_c(logit_1) > _c(logit_0)).cast("int")
