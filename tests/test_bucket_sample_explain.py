"""W3-W11 and X1 on hand-made rows."""

from pyspark.sql import functions as F

from markspark.operators import bucket, explain, sample


def test_fixed_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.01,), (0.0100001,), (1.0,)], "p double")
    got = [(r.bin_lo, r.bin_hi) for r in bucket.cut(df, "p", bucket.EDGES_27).collect()]
    assert got == [(None, None), (0.0, 0.01), (0.01, 0.02), (0.98, 1.0)]


def test_quantile_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 2, 3, 4, 5, 6, 7]], "x double")
    g = {r.qbin: r.n for r in bucket.qcut(df, "x", [0.0, 0.5, 1.0]).groupBy("qbin").count().withColumnRenamed("count", "n").collect()}
    assert g == {1: 5, 2: 5}
    edges = bucket.quantile_edges(df, "x", [i / 10 for i in range(11)])
    assert edges.count(1.0) == 1


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "x double")
    h = {r.bin: r.n for r in bucket.histogram(df, "x", bins=5).collect()}
    assert sum(h.values()) == 11 and h[4] == 3


def test_balanced_sample_equal_strata(spark):
    rows = [("a", i) for i in range(30)] + [("b", i) for i in range(100, 112)] + [("c", i) for i in range(200, 250)]
    df = spark.createDataFrame(rows, "s string, id int")
    out = sample.balanced_sample(df, ["s"], 42, ["id"])
    counts = {r.s: r["count"] for r in out.groupBy("s").count().collect()}
    assert counts == {"a": 12, "b": 12, "c": 12}
    again = sample.balanced_sample(df, ["s"], 42, ["id"])
    assert sorted(r.id for r in out.collect()) == sorted(r.id for r in again.collect())


def test_large_n_sample_uses_index(spark):
    rows = [("a", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "s string, id int")
    assert sample.sample_per_group(df, ["s"], 1500, 1, ["id"]).count() == 1500


def test_subword_merge_fixture(spark):
    texts = spark.createDataFrame([(1, "zip code")], "doc_id int, text string")
    pieces = spark.createDataFrame([(1, 0, "", 0.0), (1, 1, "zi", 0.4), (1, 2, "p ", 0.2), (1, 3, "code", 0.6),
                                    (1, 4, "", 0.0)], "doc_id int, pos int, piece string, score double")
    got = [(r.word, round(r.score, 9)) for r in explain.merge_subwords(pieces, texts).orderBy("word_pos").collect()]
    assert got == [("zip", 0.2), ("code", 0.6)]


def test_blank_pieces_skipped(spark):
    texts = spark.createDataFrame([(1, "ab cd")], "doc_id int, text string")
    pieces = spark.createDataFrame([(1, 0, "ab", 1.0), (1, 1, " ", 9.0), (1, 2, "cd", 3.0), (1, 3, "", 0.0)],
                                   "doc_id int, pos int, piece string, score double")
    got = [(r.word, r.score) for r in explain.merge_subwords(pieces, texts).orderBy("word_pos").collect()]
    assert got == [("ab", 1.0), ("cd", 3.0)]


def test_score_with_user_model(spark):
    from markspark.operators import models

    def load():
        def predict(texts):
            z = [float(len(t)) - 3.0 for t in texts]
            if any(t == "boom" for t in texts):
                raise ValueError("bad input")
            return [-x for x in z], z
        return predict

    df = spark.createDataFrame([(1, "abcdef"), (2, "ab")], "id long, text string")
    got = {r.id: r for r in models.score_with(df, load, "text", ["id"]).collect()}
    assert got[1].pred == 1 and got[2].pred == 0 and got[1].error is None
    bad = spark.createDataFrame([(3, "boom")], "id long, text string")
    r = models.score_with(bad, load, "text", ["id"], on_error="skip").first()
    assert r.logit_1 is None and "bad input" in r.error


def test_approx_edges_close(spark):
    df = spark.range(10000).select((F.col("id") % 1000).cast("double").alias("x"))
    ex = bucket.quantile_edges(df, "x", [0.0, 0.5, 1.0])
    ap = bucket.quantile_edges(df, "x", [0.0, 0.5, 1.0], approx=True)
    assert ex[0] == ap[0] and ex[-1] == ap[-1] and abs(ex[1] - ap[1]) <= 2


def test_score_with_skips_only_the_bad_row(spark):
    from markspark.operators import models

    def load():
        def predict(texts):
            if "bad" in texts:
                raise ValueError("no")
            return [0.0] * len(texts), [float(len(t)) for t in texts]
        return predict

    df = spark.createDataFrame([(i, "bad" if i == 3 else "x" * i) for i in range(7)], "id int, text string").coalesce(1)
    got = {r.id: (r.logit_1, r.error) for r in models.score_with(df, load, "text", ["id"], on_error="skip").collect()}
    assert got == {i: (None, "ValueError: no") if i == 3 else (float(i), None) for i in range(7)}


def test_topk_marks_keeps_every_top_word(spark):
    from markspark.operators import explain
    attr = spark.createDataFrame([("9", "foo,", 3.0), ("9", "bar", 2.0), ("9", "baz", 1.0), ("8", "bar", 1.0)], "c string, w string, s double")
    marks = spark.createDataFrame([("9", 1, "foo,\tbar qux"), ("9", 2, "foo"), ("9", 3, "bar  bar"), ("7", 4, "baz")], "c string, id int, mark string")
    out = explain.topk_with_marks(attr, marks, "c", "w", "s", 3, "id", "mark").collect()
    assert sorted(((r.c, r.w, r["rank"], r.id) for r in out), key=str) == sorted(
        [("9", "foo,", 1, 1), ("9", "bar", 2, 1), ("9", "bar", 2, 3), ("9", "baz", 3, None), ("8", "bar", 1, None)], key=str)
    # without its punctuation a word is looked up only where nothing holds it as it is
    out = explain.topk_with_marks(attr, marks.filter("id <> 1"), "c", "w", "s", 1, "id", "mark").collect()
    assert {(r.c, r.w, r.id) for r in out} == {("9", "foo,", 2), ("8", "bar", None)}
