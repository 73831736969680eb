"""The report from one cube with its sink, and guards in flight."""

import pytest
from pyspark.sql import functions as F

from markspark.operators import evaluate as ev, guards, order, report


def _scored(spark):
    rows = [(i, i * 7 % 3 % 2, round((i * 37 % 101) / 100, 2) if i % 3 else 0.25, None) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, label int, prob double, pred int").repartition(5)
    return df.withColumn("pred", (F.col("prob") >= 0.5).cast("int"))  # a third of the rows has one score


def _same(a, b, cols=None):
    cols = cols or sorted(a.columns)
    get = lambda d: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in
                           d.select(*[F.coalesce(c, F.lit(-9)) if c == "threshold" else c for c in cols]).collect()), key=str)
    assert get(a) == get(b)


def test_sections_equal_the_operators_on_rows(spark):
    df = _scored(spark)
    s = report.sections(report.score_cube(df))
    _same(s["confusion"], ev.confusion(df), ["label", "pred", "n", "share"])
    assert sorted(map(str, s["classes"].collect())) == sorted(map(str, ev.classification_report(df).collect()))
    assert s["auc"].first().auc == pytest.approx(ev.auc(df).first().auc)
    _same(s["roc"], ev.roc_curve(df))
    _same(s["calibration"], ev.calibration_curve(df))
    _same(s["precision"], ev.precision_at_thresholds(df, ev.arange(0.1, 1.0, 0.1)))
    _same(s["deciles"], order.decile_chart(df, 10, key=["label", "pred", "id"]))
    assert sum(r.n for r in s["histogram"].collect()) == 900


def test_deciles_of_few_rows_and_one_score(spark):
    for n in (1, 7, 10, 23):
        df = spark.range(n).select((F.col("id") % 2).cast("int").alias("label"), F.lit(0.5).alias("prob"), F.lit(1).alias("pred"), "id")
        _same(report.sections(report.score_cube(df))["deciles"], order.decile_chart(df, 10, key=["label", "pred", "id"]))


def test_the_scored_table_is_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def tap(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = _scored(spark).mapInPandas(tap, "id int, label int, prob double, pred int")
    for part in report.sections(report.score_cube(df)).values():
        part.collect()
    assert seen.value == 900


def test_empty_report(spark):
    df = spark.createDataFrame([], "label int, prob double, pred int")
    s = {k: v.collect() for k, v in report.sections(report.score_cube(df)).items()}
    assert s["auc"][0].auc is None and s["deciles"] == [] and s["confusion"] == [] and len(s["roc"]) == 1 and len(s["precision"]) == 9


def test_a_report_is_published_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "r")
    a, b = spark.range(3), spark.range(4)
    first = report.publish({"a": a, "b": b}, path)

    def fail():
        raise RuntimeError("stopped before the commit")

    with pytest.raises(RuntimeError):
        report.publish({"a": b, "b": b}, path, fail)
    got = report.read_published(spark, path)
    assert {k: v.count() for k, v in got.items()} == {"a": 3, "b": 4}
    assert report.publish({"a": b}, path) > first
    assert {k: v.count() for k, v in report.read_published(spark, path).items()} == {"a": 4}


def test_guarded_lookup(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z"), (9, "w")], "k int, v string")
    lookup = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, name string")
    path = str(tmp_path / "g")
    guard = guards.guarded_lookup(df, lookup, ["k"], path, expect_n=4)
    assert (guard.rows_in, guard.rows_out, guard.matched) == (4, 4, 2) and guard.holds
    rows = report.read_published(spark, path)["rows"]
    assert sorted(map(str, rows.collect())) == sorted(map(str, df.join(lookup, ["k"], "left").collect()))
    twice = lookup.unionByName(lookup.filter("k = 1"))
    with pytest.raises(guards.GuardFailed):
        guards.guarded_lookup(df, twice, ["k"], path)
    with pytest.raises(guards.GuardFailed):
        guards.guarded_lookup(df, lookup, ["k"], path, expect_n=5)
    assert report.read_published(spark, path)["rows"].count() == 4  # the last good one
    bad = guards.guarded_lookup(df, twice, ["k"], str(tmp_path / "none"), raise_on_fail=False)
    assert (bad.rows_in, bad.rows_out, bad.holds) == (4, 5, False) and not (tmp_path / "none" / "commits").exists()
