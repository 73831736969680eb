"""Rank selection without sorts: quantiles by brackets, samples by radix selection."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from markspark.operators import order, sample, selection


def _quantiles(values, qs):
    v = sorted(values)
    out = []
    for q in qs:
        p = q * (len(v) - 1)
        lo, hi = v[math.floor(p)], v[math.ceil(p)]
        out.append(lo if p == math.floor(p) else lo + (p - math.floor(p)) * (hi - lo))
    return out


QS = [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]


def _groups(seed=1):
    rng = random.Random(seed)
    rows = [("hot", 3.5) for _ in range(4000)] + [("hot", rng.gauss(3, 2)) for _ in range(5000)]
    rows += [("few", float(i)) for i in range(5)] + [(None, rng.random()) for _ in range(2500)] + [("one", 7.0), ("hot", None), ("none", None)]
    rng.shuffle(rows)
    return rows


def test_quantiles_equal_sorted_values(spark, monkeypatch):
    seen = []
    whole = selection.prefix_sums
    monkeypatch.setattr(selection, "prefix_sums", lambda df, *a, **k: seen.append(df.count()) or whole(df, *a, **k))
    rows = _groups()
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: r._q for r in selection.bracketed_quantiles(df, "v", QS, ["g"]).collect()}
    want = {g: _quantiles([v for k, v in rows if k == g and v is not None], QS) for g in ("hot", "few", None, "one")}
    assert set(got) == set(want)
    for g in want:
        assert got[g] == pytest.approx(want[g], abs=1e-12)
    # the value of a third of the rows is one row; of the others only those in brackets are put in order
    assert len(seen) == 1 and seen[0] < 1200


def test_quantiles_hot_value_plan_sorts_no_input(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") / 10.0).alias("v"))
    base = df.select(F.lit(0).alias("_one"), F.col("v").alias("_v"))
    counts = selection._inside(base, selection._brackets(base, ["_one"], QS, True), ["_one"])
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Sort " not in plan and "rangepartitioning" not in plan
    assert counts.count() < 0.1 * 30_000
    got = selection.bracketed_quantiles(df, "v", QS).first()._q
    assert got == pytest.approx(_quantiles([5.0 if i % 3 == 0 else i / 10 for i in range(30_000)], QS), abs=1e-9)


def test_quantiles_wrong_brackets_are_found_out(spark, monkeypatch):
    real = selection._brackets

    def wrong(base, by, qs, sketch):
        out = real(base, by, qs, sketch)
        return out.withColumn("_b", F.transform("_b", lambda b: F.struct(b["i"].alias("i"), F.lit(2.0).alias("a"), F.lit(3.0).alias("b")))) \
            if sketch else out

    monkeypatch.setattr(selection, "_brackets", wrong)
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    assert selection.bracketed_quantiles(df, "v", [0.0, 0.5, 0.95]).first()._q == [0.0, 5.0, 9.5]


def test_quantiles_empty_nan_and_names(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert selection.bracketed_quantiles(empty, "v", [0.5], ["g"]).count() == 0
    assert selection.bracketed_quantiles(empty, "v", [0.5]).first()._q == [None]
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "v double")
    q = selection.bracketed_quantiles(df, "v", [0.0, 0.5, 1.0]).first()._q
    assert q[:2] == [1.0, 2.0] and math.isnan(q[2])


def _md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


@pytest.mark.parametrize("few", [10_000, 5])
@pytest.mark.parametrize("n", [1, 7, 100, 1999, 2000, 10**6])
def test_sample_equals_sorted_hashes(spark, monkeypatch, n, few):
    monkeypatch.setattr(selection, "_FEW", few)
    rows = [(i, None if i % 5 == 0 else i % 3) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, g int").repartition(5)
    got = {}
    for r in sample.sample_per_group(df, ["g"], n, 42, ["id"]).collect():
        got.setdefault(r.g, set()).add(r.id)
    want = {}
    for g in (None, 0, 1, 2):
        ids = sorted((i for i, k in rows if k == g), key=lambda i: _md5(42, i))
        want[g] = set(ids[:n])
    assert got == want


def test_sample_repeated_keys_and_equal_rows(spark):
    # a third of the rows has one key; equal rows fill what is left of a group's n
    rows = [("a", 1, "x")] * 400 + [("a", i, "y") for i in range(2, 500)] + [("b", 1, "x")] * 10
    df = spark.createDataFrame(rows, "g string, k int, v string").repartition(4)
    for n in (3, 300, 500, 800):
        got = Counter((r.g, r.k, r.v) for r in sample.sample_per_group(df, ["g"], n, 1, ["k"]).collect())
        order_ = sorted(rows, key=lambda r: (_md5(1, r[1]), r[1]))
        want = Counter([r for r in order_ if r[0] == "a"][:n]) + Counter([r for r in order_ if r[0] == "b"][:n])
        assert got == want


def test_sample_without_groups_strict_and_empty(spark):
    df = spark.range(100).select("id", (F.col("id") % 2).alias("g"))
    assert sample.sample_per_group(df, [], 10, 3, ["id"]).count() == 10
    assert sample.sample_per_group(df, ["g"], 0, 3, ["id"]).count() == 0
    assert sample.sample_per_group(df.limit(0), ["g"], 5, 3, ["id"]).count() == 0
    with pytest.raises(ValueError):
        sample.sample_per_group(df, ["g"], 51, 3, ["id"], strict=True)
    assert sample.balanced_sample(df.filter("id < 60 or g = 0"), ["g"], 3, ["id"]).groupBy("g").count().count() == 2


def test_order_quantiles_use_brackets(spark):
    df = spark.createDataFrame([(float(x),) for x in np.random.default_rng(0).integers(0, 50, 4000)], "v double")
    got = order.exact_quantiles(df, "v", [0.1, 0.5]).first()._q
    assert got == pytest.approx(_quantiles([r.v for r in df.collect()], [0.1, 0.5]))
