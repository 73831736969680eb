"""P1-P16, W1, A1 on hand-made rows; pushdown of the year filter."""

import datetime as dt

from pyspark.sql import functions as F

from markspark.operators import clean, stats


def test_latest_per_key(spark):
    d = dt.date
    rows = [("X", d(2012, 1, 1), 1), ("X", d(2013, 5, 5), 2), ("Y", d(2015, 1, 1), 3), ("Y", None, 4),
            ("x", d(2012, 1, 1), 5)]
    df = spark.createDataFrame(rows, "mark string, dt date, id int")
    got = sorted(r.id for r in clean.latest_per_key(df, "mark", "dt", "id").collect())
    assert got == [2, 4, 5]


def test_exactly_one_and_exclude(spark):
    rows = [(1, "9"), (2, "9"), (2, "35"), (3, "A"), (4, "200"), (5, None)]
    df = spark.createDataFrame(rows, "k int, c string")
    one = stats.exactly_one(df, "k", "c")
    assert sorted(r.k for r in one.collect()) == [1, 3, 4]
    ex = clean.exclude_codes(one, "c", ["A", "B", "200"])
    assert [(r.k, r.c) for r in ex.collect()] == [(1, 9)]


def test_year_filter_pushed_down(spark, tmp_path):
    df = spark.createDataFrame([(dt.datetime(2011, 12, 31), 1), (dt.datetime(2012, 1, 1), 2),
                                (dt.datetime(2019, 12, 31, 23), 3), (dt.datetime(2020, 1, 1), 4), (None, 5)],
                               "d timestamp_ntz, id int")
    p = str(tmp_path / "t")
    df.write.parquet(p)
    f = clean.year_between(spark.read.parquet(p), "d", 2012, 2019)
    assert sorted(r.id for r in f.collect()) == [2, 3]
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(d," in plan and "LessThan(d," in plan


def test_split_by_prefix_null_is_rest(spark):
    df = spark.createDataFrame([(" PM1", 1), ("XPM", 2), (None, 3)], "c string, id int")
    pm, rest = clean.split_by_prefix(df, "c", "PM")
    assert [r.id for r in pm.collect()] == [1]
    assert sorted(r.id for r in rest.collect()) == [2, 3]


def test_time_split_disjoint(spark):
    d = dt.date
    df = spark.createDataFrame([(d(1999, 12, 31),), (d(2000, 1, 1),), (d(2001, 6, 1),), (None,)], "d date")
    got = [r.split for r in clean.time_split(df, "d", "1999-12-31", "2000-12-31").collect()]
    assert got == ["train", "val", "test", None]


def test_normalize_key(spark):
    df = spark.createDataFrame([(" 12 ",), ("x1",), (None,)], "k string")
    assert [r.k for r in clean.normalize_key(df, "k").collect()] == [12]


def test_concat_text_ordered(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "k int, s int, t string")
    got = {r.k: r.t for r in stats.concat_text(df, "k", "t", "s").collect()}
    assert got == {1: "a b", 2: "c"}
