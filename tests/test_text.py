"""F1-F11 against the hand-made rows."""

from pyspark.sql import functions as F

from markspark.functions import templates, text


def test_clean_and_count(spark):
    rows = [("Café-Naïve, été_1", "cafénaïve été_1", "CaféNaïve été_1", 2),
            ("  A  & B! ", "  a   b ", "  A   B ", 2), ("!!!", "", "", 0), ("", "", "", 0)]
    df = spark.createDataFrame(rows, "t string, cl string, sp string, n int")
    got = df.select(text.clean_lower("t").alias("cl"), text.strip_punct("t").alias("sp"),
                    text.word_count(text.strip_punct("t")).alias("n")).collect()
    for r, (_, cl, sp, n) in zip(got, rows):
        assert (r.cl, r.sp, r.n) == (cl, sp, n)


def test_pseudo_mark(spark):
    df = spark.createDataFrame([("SCENE",), (None,)], "p string")
    assert [r[0] for r in df.select(text.pseudo_mark_text("p")).collect()] == ["Pseudo mark is SCENE", "no Pseudo mark"]


def test_model_input_null_propagates(spark):
    cols = templates.segments("full", processed=False)
    row = {c: c.upper() for c in cols}
    df = spark.createDataFrame([row, {**row, cols[3]: None}])
    got = df.select(templates.model_input("full", "cls", processed=False).alias("x")).collect()
    assert got[0].x.startswith("[CLS] MARK_UNPROCESSED [SEP] STATEMENT_UNPROCESSED")
    assert got[1].x is None


def test_shuffled_is_a_permutation(spark):
    cols = templates.segments("full", processed=False)
    df = spark.createDataFrame([{**{c: c for c in cols}, "k": i} for i in range(5)])
    got = df.select(templates.model_input("shuffled", "cls", False, seed=7, key="k").alias("x")).collect()
    for r in got:
        assert sorted(r.x[len("[CLS] "):].split(" [SEP] ")) == sorted(cols)
    assert len({r.x for r in got}) > 1


def test_strip_markers_and_tokens(spark):
    df = spark.createDataFrame([("[CLS] a [SEP] b", "x-y!")], "t string, w string")
    r = df.select(text.strip_markers("t").alias("s"), text.strip_ascii_punct("w").alias("w"),
                  text.has_token(F.lit("zip code"), "code").alias("h")).first()
    assert (r.s, r.w, r.h) == (" a  b", "xy", True)


def test_split_frame(spark):
    df = spark.range(100)
    assert text.split_frame(df, 5).rdd.getNumPartitions() == 5
