"""L1-L6 against the hand-made rows and the rule-by-rule form."""

import itertools

from pyspark.sql import functions as F

from markspark.operators import label


def _rule_by_rule(pub, acq, supp, desc, gen):
    """The ordered, overwriting assignments with pandas comparison semantics
    (a missing value is unequal to everything)."""
    eq = lambda a, b: a is not None and a == b
    ne = lambda a, b: not eq(a, b)
    y = -1
    if eq(pub, 1) and eq(acq, 0):
        y = 1
    if eq(pub, 0) and eq(gen, 0) and eq(desc, 0) and eq(supp, 0):
        y = 1
    if eq(pub, 1) and eq(acq, 1):
        y = 0
    if eq(pub, 0) and ne(desc, 0):
        y = 0
    if eq(pub, 0) and ne(gen, 0):
        y = 0
    if eq(supp, 1):
        y = 0
    return 0 if y == -1 else y


SCHEMA = "pub_ind int, acq_dist_in int, supp_reg_in int, descriptive_sum int, generic_sum int"


def test_label_fixture(spark):
    rows = [(1, 0, 0, None, None, 1), (1, 1, 0, None, None, 0), (1, 0, 1, 0, 0, 0), (1, 0, None, None, None, 1),
            (1, None, 0, 0, 0, 0), (0, 0, 0, 0, 0, 1), (0, 0, 0, 2, 0, 0), (0, 0, 0, 0, 1, 0),
            (0, 0, 0, None, None, 0), (0, 0, None, 0, 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA + ", expected int")
    got = df.select(label.distinct_rule().alias("y"), "expected").collect()
    assert all(r["y"] == r["expected"] for r in got)


def test_label_all_combinations(spark):
    vals = [0, 1, None]
    sums = [0, 2, None]
    combos = list(itertools.product([0, 1], vals, vals, sums, sums))
    df = spark.createDataFrame(combos, SCHEMA)
    got = df.select("*", label.distinct_rule().alias("y")).collect()
    assert len(got) == 162
    for r in got:
        assert r["y"] == _rule_by_rule(*[r[c] for c in SCHEMA_COLS])


SCHEMA_COLS = [c.split()[0] for c in SCHEMA.split(", ")]


def test_mark_type(spark):
    df = spark.createDataFrame([("arbitrary/fanciful",), ("suggesitve",), ("highly descriptive",), ("Generic",), (None,)],
                               "t string")
    got = [r[0] for r in df.select(label.mark_type("t")).collect()]
    assert got == ["arbitrary", "suggestive", "descriptive", "none", "none"]


def test_argmax_and_threshold_differ(spark):
    df = spark.createDataFrame([(0.5, 0.2, 0.55), (-1.0, 0.1, 0.52)], "logit_0 double, logit_1 double, prob double")
    got = df.select(label.predict_argmax().alias("a"), label.predict_threshold("prob", 0.5).alias("t")).collect()
    assert [(r.a, r.t) for r in got] == [(0, 1), (1, 1)]


def test_translation_text(spark):
    df = spark.createDataFrame([("SOL", "SUN"), ("ACME", "ACME"), ("Acme ", "acme")], "m string, f string")
    ind, txt = label.translation_text("m", "f")
    got = df.select(ind.alias("i"), txt.alias("t")).collect()
    assert [(r.i, r.t) for r in got] == [(1.0, "SUN"), (0.0, "no translation required"), (0.0, "no translation required")]
