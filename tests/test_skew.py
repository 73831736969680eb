"""A third of all rows on one key: results stay whole and exact."""

import datetime as dt

from pyspark.sql import functions as F

from markspark.operators import clean, evaluate as ev, joins, order, sample, stats


def _hot(spark, n=3000):
    # key 0 holds a third of the rows
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
                                 F.col("id"), (F.col("id") % 7).cast("double").alias("v"))


def test_latest_per_key_hot(spark):
    df = _hot(spark).withColumn("d", F.date_add(F.lit(dt.date(2000, 1, 1)), (F.col("id") % 50).cast("int")))
    out = {r.k: r.id for r in clean.latest_per_key(df, "k", "d", "id").collect()}
    best0 = max((i % 50, i) for i in range(0, 3000, 3))[1]
    assert out[0] == best0 and len(out) == 1 + 2000


def test_exact_quantiles_hot_group(spark):
    df = _hot(spark).withColumn("g", (F.col("k") == 0).cast("int"))
    q = {r.g: r._q for r in order.exact_quantiles(df, "v", [0.5, 1.0], ["g"]).collect()}
    import statistics
    vals0 = sorted(float(i % 7) for i in range(0, 3000, 3))
    assert q[1][0] == statistics.median(vals0) and q[1][1] == max(vals0)


def test_sample_hot_group_large_n(spark):
    df = _hot(spark).withColumn("g", (F.col("k") == 0).cast("int"))
    out = sample.sample_per_group(df, ["g"], 1200, 5, ["id"])
    counts = {r.g: r["count"] for r in out.groupBy("g").count().collect()}
    assert counts == {0: 1200, 1: 1000}


def test_lexicon_hot_token(spark):
    rows = [(i, "the " * 5 + ("rare" if i == 7 else "x")) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lex = spark.createDataFrame([("rare",), ("zzz",)], "token string")
    got = {r.doc_id: r.wn_ind for r in joins.lexicon_indicator(df, "doc_id", "text", lex).collect()}
    assert sum(got.values()) == 1 and got[7] == 1 and len(got) == 300


def test_auc_hot_score(spark):
    # a third of the rows share one score
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(F.col("id") / 3000.0).alias("prob"),
                                  (F.col("id") % 2).cast("int").alias("label"))
    pdf = df.toPandas()
    pos, neg = pdf[pdf.label == 1].prob.values, pdf[pdf.label == 0].prob.values
    import numpy as np
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    assert abs(ev.auc(df).first().auc - wins / (len(pos) * len(neg))) < 1e-12


def test_exactly_one_hot(spark):
    df = _hot(spark).select("k", F.lit("c").alias("c"))
    assert stats.exactly_one(df, "k", "c").filter("k = 0").count() == 0
