"""Bootstrap by multinomial splitting, and Shapley attribution of any scorer."""

import math
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from markspark.operators import attribution, evaluate as ev, models, resample


def _scored(spark, n=3000):
    rng = np.random.default_rng(5)
    label = (rng.random(n) < 0.4).astype(int)
    prob = np.clip(np.round(0.3 * label + rng.random(n) * 0.7, 2), 0, 1)
    prob[: n // 3] = 0.5  # a third of the rows on one score
    rows = [(int(a), float(b), int(b >= 0.5)) for a, b in zip(label, prob, strict=True)]
    return spark.createDataFrame(rows, "label int, prob double, pred int").repartition(6), rows


def test_split_bootstrap_draws_n_rows_and_spreads_like_a_bootstrap(spark):
    df, rows = _scored(spark)
    out = resample.split_bootstrap(df, rounds=60, seed=3).orderBy("round").collect()
    assert [r["round"] for r in out] == list(range(60)) and all(r["n"] == len(rows) for r in out)
    accuracy = sum(a == p for a, _, p in rows) / len(rows)
    got = np.array([r["accuracy"] for r in out])
    sigma = math.sqrt(accuracy * (1 - accuracy) / len(rows))
    assert abs(got.mean() - accuracy) < 4 * sigma / math.sqrt(60)
    assert 0.6 * sigma < got.std() < 1.5 * sigma
    auc = ev.auc(df).first()[0]
    assert abs(np.mean([r["auc"] for r in out]) - auc) < 0.01
    again = resample.split_bootstrap(df.repartition(2), rounds=60, seed=3).orderBy("round").collect()
    assert again == out  # draws do not depend on the partitioning


def test_split_bootstrap_auc_equals_the_weighted_pairs(spark):
    df, _ = _scored(spark, 300)
    sums = resample.round_sums(resample.score_counts(df), 4, 9).collect()
    cells = sorted(resample.score_counts(df).collect(), key=lambda r: (r.bin, r.prob))
    totals = defaultdict(int)
    for c in cells:
        totals[c.bin] += c.tp + c.fn + c.fp + c.tn
    draws = resample.split_bins(np.array([totals[b] for b in sorted(totals)]), 4, 9)
    assert (draws.sum(1) == 300).all()
    for r in range(4):
        weights = []
        for i, b in enumerate(sorted(totals)):
            one = resample.BinDraws(b, totals[b], draws[:, i], 9)
            w = one.take(np.array([(c.tp, c.fn, c.fp, c.tn) for c in cells if c.bin == b]))
            weights += list(zip([c.prob for c in cells if c.bin == b], w[r].tolist(), strict=True))
        pos = [(p, w[0] + w[1]) for p, w in weights]
        neg = [(p, w[2] + w[3]) for p, w in weights]
        pairs = sum(a * b * (1 if p > q else 0.5 if p == q else 0) for p, a in pos for q, b in neg)
        auc = pairs / (sum(a for _, a in pos) * sum(b for _, b in neg))
        assert resample.split_bootstrap(df, 4, 9).filter(F.col("round") == r).first()["auc"] == pytest.approx(auc, abs=1e-12)
        mine = [s for s in sums if s["round"] == r]
        assert sum(s["tp"] + s["fn"] + s["fp"] + s["tn"] for s in mine) == 300


def test_bin_draws_follow_the_multinomial_whatever_the_chunks(monkeypatch):
    monkeypatch.setattr(resample, "_CHUNK", 3)
    cells = np.array([[5, 0, 0, 0], [0, 3, 0, 0], [0, 0, 2, 0], [0, 0, 0, 10], [1, 1, 1, 1]] * 2)
    rounds, n = 4000, int(cells.sum())
    total = np.zeros((len(cells), 4))
    draws = resample.BinDraws(0, n, np.full(rounds, n), 1)
    for a in range(0, len(cells), 3):
        w = draws.take(cells[a:a + 3])
        total[a:a + 3] += w.sum(0)
    assert (draws.counts.sum(1) == n).all() and (draws.left_draws == 0).all()
    assert np.abs(total / rounds - cells).max() < 5 * math.sqrt(10 / rounds)


def test_split_bootstrap_edges(spark):
    empty = spark.createDataFrame([], "label int, prob double, pred int")
    assert resample.split_bootstrap(empty, 5).count() == 0
    one = spark.createDataFrame([(1, None, 1), (1, 2.0, 1), (1, float("nan"), 0)], "label int, prob double, pred int")
    out = resample.split_bootstrap(one, 5).collect()
    assert len(out) == 5 and all(r["n"] == 3 and r["auc"] is None for r in out)


WEIGHTS = {"a": 1.0, "b": -2.0, "c": 0.5}


def _linear():
    """A model (made by a nested function, so that workers need not import this file) that adds up its words."""
    weights = dict(WEIGHTS)

    def load():
        def predict(texts):
            s = [sum(weights.get(w, 0.25) for w in t.split()) + 3 for t in texts]
            return [-x for x in s], s
        return predict
    return load


def _pairs(fails=None):
    """A model that squares the number of different words; it fails on the text ``fails``."""
    def load():
        def predict(texts):
            if fails in texts:
                raise ValueError("no")
            s = [float(len(set(t.split())) ** 2) for t in texts]
            return [-x for x in s], s
        return predict
    return load


TEXTS = [(1, "a b  c a"), (2, "b"), (3, ""), (4, None), (5, "x y z a b c " * 30)]


def test_shapley_is_exact_for_a_sum_of_words(spark):
    df = spark.createDataFrame(TEXTS, "id long, text string")
    out = attribution.shapley(df, "id", "text", _linear(), samples=2).collect()
    assert len(out) == 4 + 1 + 180
    for r in out:
        assert r.attr == pytest.approx(WEIGHTS.get(r.token, 0.25), abs=1e-9) and r.base == pytest.approx(3)


@pytest.mark.parametrize("players", [256, 7, 1])
def test_shapley_adds_up_for_any_scorer(spark, players):
    df = spark.createDataFrame(TEXTS, "id long, text string")
    out = attribution.shapley(df, "id", "text", _pairs(), samples=3, players=players).collect()
    for i, t in ((1, 9.0), (2, 1.0), (5, 36.0)):
        mine = [r for r in out if r.id == i]
        assert {(r.base, r.score) for r in mine} == {(0.0, t)}
        assert sum(r.attr for r in mine) == pytest.approx(t, abs=1e-9)
        assert [r.pos for r in sorted(mine, key=lambda r: r.pos)] == list(range(len(mine)))


def test_shapley_tends_to_the_mean_over_all_orders(spark):
    words = "a b a c".split()
    want = [0.0] * 4
    for order in permutations(range(4)):
        have, before = set(), 0
        for i in order:
            have.add(words[i])
            want[i] += (len(have) ** 2 - before) / 24
            before = len(have) ** 2
    df = spark.createDataFrame([(1, "a b a c")], "id long, text string")
    out = attribution.shapley(df, "id", "text", _pairs(), samples=600).collect()
    assert [r.attr for r in sorted(out, key=lambda r: r.pos)] == pytest.approx(want, abs=0.3)


def test_shapley_texts_grow_with_samples_and_words(spark):
    df = spark.createDataFrame(TEXTS, "id long, text string")
    n = [attribution.masked_texts(df, "id", "text", s, 1, 256, None).count() for s in (1, 3)]
    assert n == [5 + 2 + 181, 3 * (5 + 2 + 181)]
    assert attribution.masked_texts(df, "id", "text", 1, 1, 10, None).count() == 5 + 2 + 11


def test_shapley_spreads_what_a_failed_text_leaves_over(spark):
    df = spark.createDataFrame([(1, "a b c")], "id long, text string")
    out = attribution.shapley(df, "id", "text", _pairs("a"), samples=8, on_error="skip").collect()
    assert sum(r.attr for r in out) == pytest.approx(9.0)


def test_score_with_bounds_its_calls(spark):
    def load():
        def predict(texts):
            assert sum(map(len, texts)) <= 100 or len(texts) == 1
            return [0.0] * len(texts), [float(len(t)) for t in texts]
        return predict

    df = spark.createDataFrame([(i, "x" * (i * 7 % 160)) for i in range(200)], "id long, text string").coalesce(1)
    out = models.score_with(df, load, "text", ["id"], batch_chars=100).collect()
    assert {r.id: r.logit_1 for r in out} == {i: float(i * 7 % 160) for i in range(200)}
