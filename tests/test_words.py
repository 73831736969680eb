"""Word forms in the lexicon lookup (J11) and unit-length word vectors (M1)."""

import math

import pytest
from pyspark.sql import functions as F

from markspark.operators import features, joins


def test_word_forms(spark):
    words = ["running", "boxes", "cities", "men", "s", "", None, "baked", "glass"]
    d = spark.createDataFrame([(w,) for w in words], "w string").select("w", joins.word_forms("w", joins.ENGLISH_FORMS).alias("f"))
    got = {r.w: r.f for r in d.collect()}
    assert {"running", "runn", "runne"} == set(got["running"]) and "box" in got["boxes"] and "city" in got["cities"]
    assert got["men"] == ["men"] and got["s"] == ["s"] and got[""] == [""] and got[None] == []
    assert "bake" in got["baked"] and "glas" in got["glass"]
    assert all(len(f) == len(set(f)) for f in got.values())


def test_lexicon_by_form_and_exception(spark):
    lex = spark.createDataFrame([("bake",), ("box",), ("mouse",), (None,)], "token string")
    rows = [(1, "Baked goods"), (2, "two boxes"), (3, "mice"), (4, "nothing here"), (5, None), (6, ""), (7, "geese"), (8, "boxes " * 5000)]
    d = spark.createDataFrame(rows, "id long, text string")
    odd = spark.createDataFrame([("mice", "mouse"), ("geese", "goose"), (None, "box"), ("x", None)], "form string, lemma string")
    got = lambda **k: {r.id for r in joins.lexicon_indicator(d, "id", "text", lex, **k).collect() if r.wn_ind}
    assert got() == set()
    assert got(rules=joins.ENGLISH_FORMS) == {1, 2, 8}
    assert got(rules=joins.ENGLISH_FORMS, exceptions=odd) == {1, 2, 3, 8}
    assert joins.lexicon_indicator(d, "id", "text", lex, rules=joins.ENGLISH_FORMS).count() == len(rows)


def test_word_vectors_have_length_one_before_the_mean(spark):
    wv = spark.createDataFrame([("big", [30.0, 40.0]), ("small", [0.0, 0.1]), ("zero", [0.0, 0.0])], "token string, vector array<float>")
    d = spark.createDataFrame([(1, "Big small"), (2, "big zero big"), (3, "zero"), (4, None), (5, "unknown")], "id long, text string")
    got = {r.id: r.vector for r in features.sentence_vectors(d, "id", "text", wv).collect()}
    assert got[1] == pytest.approx([0.3, 0.9], abs=1e-6) and got[2] == pytest.approx([0.6, 0.8], abs=1e-6)
    assert got[3] == got[4] == got[5] == [0.0, 0.0]
    one = features.sentence_vectors(d.filter(F.col("id") == 2), "id", "text", wv).first().vector
    assert math.isclose(math.hypot(*one), 1.0, abs_tol=1e-6)


def test_unknown_tokens_have_the_mean_of_their_ngrams(spark, monkeypatch):
    from hashlib import md5
    monkeypatch.setattr(features, "NGRAM_PIECE", 8)
    buckets = 50
    table = {b: [float(b % 7) - 3, float(b % 11)] for b in range(buckets) if b % 3}
    grams = spark.createDataFrame(list(table.items()), "bucket long, vector array<float>")
    wv = spark.createDataFrame([("known", [1.0, 2.0])], "token string, vector array<float>")
    texts = ["Known a", "boxes boxes running", "überlang" * 5, "abcdef", "abcdefg", "x" * 5_000, "", None, "known known"]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "id long, text string, token string, bucket int").repartition(3)
    got = {r.token: r.vector for r in features.with_unknown(d, "text", wv, grams, buckets).collect()}
    want = {"known": [1.0, 2.0]}
    for t in {w for x in texts for w in (x or "").lower().split()} - {"known"}:
        w = f"<{t}>"
        found = [int(md5(w[i:i + n].encode()).hexdigest()[:8], 16) % buckets for n in range(3, 7) for i in range(len(w) - n + 1)]
        v = [table[b] for b in found if b in table]
        if v:
            want[t] = [sum(x) / len(v) for x in zip(*v, strict=True)]
    assert set(got) == set(want) and "überlang" * 5 in got
    for t, v in want.items():
        assert got[t] == pytest.approx(v, abs=1e-9), t
    assert features.with_unknown(d, "text", wv, grams.limit(0), buckets).count() == features.with_unknown(d.limit(0), "text", wv, grams, buckets).count() == 1


def test_one_hot_names_a_bounded_number_of_columns(spark):
    d = spark.createDataFrame([(3,), (1,), (None,)], "c int")
    assert features.one_hot(d, "c", "x_").columns == ["x_1", "x_3"]
    with pytest.raises(ValueError, match="distinct values"):
        features.one_hot(spark.range(features.MAX_CODES + 1), "id", "x_")
