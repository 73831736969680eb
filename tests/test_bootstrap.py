"""Bootstrap draws against brute force: several blocks, runs and rounds, ties, nulls and long keys."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from markspark.operators import bootstrap as bs


def _head(*parts):
    return int(hashlib.md5("|".join(str(p) for p in parts if p is not None).encode()).hexdigest()[:15], 16)


def _rows(n, key=lambda i: i):
    return [(key(i), None if i % 97 == 5 else i % 3 % 2, None if i % 89 == 7 else (i * 37 % 50) / 50, i % 2) for i in range(n)]


def _table(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"id {kind}, label int, prob double, pred int").repartition(5)


def test_draws_are_dealt_out_by_block_and_are_no_rows(spark):
    n, rounds = 5000, 7
    d = bs.draws(spark, n, rounds, 3)
    got, size = Counter(), 1 << bs.block_bits(rounds)
    rows = d.collect()
    assert len(rows) < n  # before: one row a draw, 35,000
    for r in rows:
        counts = memoryview(r.counts).cast("i").tolist()
        places = iter(memoryview(r.places).cast("H").tolist())
        for rnd, c in enumerate(counts):
            for _ in range(c):
                got[rnd, r.block * size + next(places)] += 1
        assert next(places, None) is None
    assert got == Counter((r, _head(3, r, k) % n) for r in range(rounds) for k in range(n))


@pytest.mark.parametrize("n", [1, 700])
def test_exact_weights_equal_brute_force_over_many_blocks(spark, monkeypatch, n):
    monkeypatch.setattr(bs, "_MET", 1)  # blocks of 256 rows
    monkeypatch.setattr(bs, "_MADE", 450)  # runs of 150 numbers
    rows, rounds = _rows(n), 3
    ix = bs.global_index(_table(spark, rows), ["id"], keep=["prob", "label", "pred"])
    assert ix.columns == ["prob", "label", "pred", "idx", "n_total"]
    got = Counter()
    for r in bs.drawn_weights(ix, bs.draws(spark, n, rounds, 9), rounds).collect():
        got[r.round, r.prob, r.label, r.pred] += r.w
    want = Counter()
    for rnd in range(rounds):
        for k in range(n):
            _, label, prob, pred = rows[_head(9, rnd, k) % n]
            want[rnd, prob, label, pred] += 1
    assert got == want


@pytest.mark.parametrize("key", [lambda i: str(i % 600), lambda i: "ü" * (i % 40), lambda i: None if i % 7 == 0 else "k" * 60 + str(i)])
def test_poisson_weights_equal_brute_force(spark, monkeypatch, key):
    monkeypatch.setattr(bs, "_MADE", 1 << 10)
    rows, rounds, cdf = _rows(700, key), 12, bs.poisson1_cdf()
    got = Counter()
    for r in bs.poisson_weights(_table(spark, rows, "string"), ["id"], rounds, 5).collect():
        got[r.round, r.prob, r.label, r.pred] += r.w
    want = Counter()
    for rnd in range(rounds):
        for k, label, prob, pred in rows:
            u = float(_head(5, rnd, k)) / float(1 << 60)
            want[rnd, prob, label, pred] += next((i for i, c in enumerate(cdf) if u < c), 16)
    assert +got == +want and set(got) == set(want)


def test_empty_table_has_no_rounds(spark):
    none = _table(spark, _rows(2)).filter(F.col("id") < 0)
    for method in ("exact", "poisson"):
        assert bs.bootstrap(none, ["id"], rounds=3, method=method).count() == 0
