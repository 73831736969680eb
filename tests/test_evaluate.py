"""E1-E16 against the hand-made rows and properties."""

import pytest
from pyspark.sql import functions as F

from markspark.operators import calibrate as cal
from markspark.operators import evaluate as ev

ROWS = [(0.9, 1, 1, 1), (0.8, 1, 0, 2), (0.7, 1, 1, 3), (0.4, 0, 1, 4), (0.2, 0, 0, 5)]


@pytest.fixture
def scored(spark):
    return spark.createDataFrame(ROWS, "prob double, pred int, label int, row_id int")


def test_report_fixture(scored):
    c = scored.transform(lambda d: ev.confusion_counts(d)).first()
    assert (c.tn, c.fp, c.fn, c.tp) == (1, 1, 1, 2)
    rep = {r.class_name: r for r in ev.classification_report(scored).collect()}
    assert rep["accuracy"].f1 == pytest.approx(0.6)
    assert rep["1"].precision == pytest.approx(2 / 3) and rep["1"].recall == pytest.approx(2 / 3)
    assert rep["0"].f1 == pytest.approx(0.5) and rep["1"].support == 3 and rep["0"].support == 2
    assert rep["weighted avg"].f1 == pytest.approx(0.6)


def test_auc_and_youden(scored, spark):
    assert ev.auc(scored).first().auc == pytest.approx(4 / 6)
    assert ev.youden_threshold(scored).first().threshold == 0.4
    ties = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.2, 0)], "prob double, label int")
    assert ev.auc(ties).first().auc == pytest.approx(0.75)


def test_auc_symmetry_and_temperature_invariance(spark):
    df = spark.range(500).select(F.rand(11).alias("prob"), (F.rand(12) > 0.6).cast("int").alias("label"))
    a = ev.auc(df).first().auc
    b = ev.auc(df.withColumn("prob", 1 - F.col("prob"))).first().auc
    assert a == pytest.approx(1 - b)
    z = df.withColumn("logit_1", F.ln(F.col("prob") / (1 - F.col("prob"))))
    t = cal.apply_temperature(z, 0.5).withColumn("prob", F.col("prob_t"))
    assert ev.auc(t).first().auc == pytest.approx(a)


def test_temperature_fit_beats_grid(spark):
    df = spark.range(2000).select(F.rand(5).alias("u"))
    df = df.select((F.lit(1) / (1 + F.exp(-(F.col("u") * 6 - 3) * 1.7))).alias("prob"),
                   (F.rand(6) < F.col("u")).cast("int").alias("label"))
    fit = cal.fit_temperature(df)
    grid = cal.temperature_grid(df, [0.3, 0.5, 0.8, 1.0, 1.5, 2.0, 3.0]).collect()
    assert all(fit["loss"] <= r.loss + 1e-12 for r in grid)


def test_precision_at_thresholds_fixture(scored):
    got = {round(r.threshold, 6): r for r in ev.precision_at_thresholds(scored, [0.5]).collect()}
    r = got[0.5]
    assert (r.n1_pred, r.n0_pred, r.n1_actual, r.n0_actual, r.n_total) == (3, 2, 3, 2, 5)
    assert r.prec1 == pytest.approx(2 / 3) and r.prec0 == pytest.approx(0.5)


def test_arange_matches_numpy():
    np = pytest.importorskip("numpy")
    assert ev.arange(0.1, 1.0, 0.1) == list(np.arange(0.1, 1, 0.1))
    assert ev.arange(0.0, 1.0, 0.01) == list(np.arange(0, 1, 0.01))


def test_stratum_sweep(spark):
    df = spark.createDataFrame([("a", 0.05, 1), ("a", 0.5, 1), ("b", 0.995, 0), ("b", 0.01, 0)],
                               "s string, p double, y int")
    got = {(r.stratum, round(r.threshold, 2)): r.perf for r in ev.stratum_threshold_sweep(df, "s", "p", "y").collect()}
    assert got[("a", 0.0)] == 100.0 and got[("a", 0.06)] == 50.0 and got[("a", 0.51)] == 0.0
    assert got[("b", 0.0)] == 0.0 and got[("b", 0.02)] == 50.0 and got[("b", 0.99)] == 50.0
