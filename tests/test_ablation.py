"""Variants fitted together against a dense fit of each, and the defined results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from markspark.operators import ablation as ab

B = 64


def rows_of(spark, n=60):
    data = []
    for i in range(n):
        good = i % 3 != 0
        data.append((i, f"{'bright' if good else 'dull'} word{i % 7} word{i % 5} word{i % 5}", "red" if i % 2 else None,
                     None if i == 4 else int(good if i % 10 else not good)))
    return spark.createDataFrame(data, "id long, a string, b string, y int").repartition(3)


def variants():
    return {"full": ab.fixed_order(0, 1), "only_a": ab.fixed_order(0), "wo_a": ab.fixed_order(1), "shuffled": ab.shuffled_order("id", 2)}


def newton(x, y, reg):
    """Dense fit by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w, pen = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, reg), 0]
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(pen + 1e-12)
        w -= np.linalg.solve(h, x.T @ (p - y) / len(y) + pen * w)
    return w


def test_variants_equal_a_fit_of_their_own(spark):
    rows = ab.variant_rows(rows_of(spark), "id", "y", [F.col("a"), F.col("b")], variants(), B, F.col("id") % 5 == 0)
    fit = ab.fit_together(rows, list(variants()), B, reg=0.01, tol=1e-8)
    got = {(r.variant, r.id): r.prob for r in ab.score_variants(rows, fit, "id").collect()}
    assert len(got) == 240 and fit.evaluations < 100
    stored = rows.collect()
    for v, name in enumerate(variants()):
        own = [r for r in stored if r.variant == v]
        learn = [r for r in own if not r.test and r.label is not None]
        df = np.zeros(B)
        for r in learn:
            df[r.idx] += 1
        idf = np.log((len(learn) + 1) / (df + 1))

        def dense(rs, idf=idf):
            x = np.zeros((len(rs), B))
            for i, r in enumerate(rs):
                x[i, r.idx] = np.array(r.tf) * idf[r.idx]
            return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

        w = newton(dense(learn), np.array([r.label for r in learn]), 0.01)
        want = 1 / (1 + np.exp(-(np.c_[dense(own), np.ones(len(own))] @ w)))
        assert [got[name, r.id] for r in own] == pytest.approx(list(want), abs=1e-4)


def test_segments_orders_and_terms(spark):
    rows = ab.variant_rows(rows_of(spark), "id", "y", [F.col("a"), F.col("b")], variants(), 1 << 18, F.lit(False)).collect()
    n = {(r.variant, r.id): sum(r.tf) for r in rows}
    assert (n[0, 1], n[1, 1], n[2, 1], n[3, 1]) == (10, 8, 2, 10)  # a token counts as a word and at its place
    assert (n[0, 2], n[2, 2]) == (8, 0)
    by = {(r.variant, r.id): set(r.idx) for r in rows}
    same = [by[0, i] == by[3, i] for i in range(1, 60, 2)]
    assert any(same) and not all(same)
    orders = spark.range(2000).select(ab.shuffled_order("id", 3).alias("o")).groupBy("o").count().collect()
    assert len(orders) == 6 and all(math.isclose(r["count"], 333, abs_tol=100) for r in orders)


def test_nothing_to_learn_from(spark):
    empty = rows_of(spark).limit(0)
    rows = ab.variant_rows(empty, "id", "y", [F.col("a")], {"a": ab.fixed_order(0)}, B, F.lit(False))
    fit = ab.fit_together(rows, ["a"], B)
    assert ab.score_variants(rows, fit, "id").count() == 0
    rows = ab.variant_rows(rows_of(spark), "id", "y", [F.col("a")], {"a": ab.fixed_order(0)}, B, F.lit(True))
    probs = {r.prob for r in ab.score_variants(rows, ab.fit_together(rows, ["a"], B), "id").collect()}
    assert probs == {0.5}


def test_a_step_is_one_job_without_a_join(spark):
    rows = ab.variant_rows(rows_of(spark), "id", "y", [F.col("a")], {"a": ab.fixed_order(0)}, B, F.lit(False))
    plan = ab.score_variants(rows, ab.fit_together(rows, ["a"], B), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_what_a_step_shuffles_does_not_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ab, "_TERMS", 40)
    monkeypatch.setattr(ab, "_PART", 50)
    rows = ab.variant_rows(rows_of(spark, 300), "id", "y", [F.col("a"), F.col("b")], variants(), B, F.lit(False))
    idf = spark.sparkContext.broadcast(np.random.default_rng(1).uniform(0.5, 2, (4, B)))
    train = rows.filter("label is not null").repartition(23)
    blocks = ab._scaled_blocks(train, idf)
    assert 23 <= blocks.count() < train.count()
    w, bias = np.random.default_rng(2).normal(size=(4, B)), np.arange(4.0)
    sent = []

    def counted(self, *a, _of=type(blocks).repartition):
        sent.append(self.count())
        return _of(self, *a)

    monkeypatch.setattr(type(blocks), "repartition", counted)
    n, loss, db, dw = ab._loss_and_gradient(blocks, w, bias)
    assert sent[0] <= spark.sparkContext.defaultParallelism * -(-(12 + 4 * B) // 50)  # before: up to 23 tasks x (12 + 4 B) rows
    want = np.zeros((4, B + 3))
    for r in train.collect():
        x = np.zeros(B)
        x[r.idx] = np.array(r.tf) * idf.value[r.variant, r.idx]
        x /= max(np.linalg.norm(x), 1e-300)
        m = x @ w[r.variant] + bias[r.variant]
        off = 1 / (1 + math.exp(-m)) - r.label
        want[r.variant] += [*(x * off), 1, math.log1p(math.exp(m)) - r.label * m, off]
    assert np.allclose(np.c_[dw, n, loss, db], want)
