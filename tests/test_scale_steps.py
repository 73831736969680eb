"""Steps that are made once: the delay join, the stored model input, vectors of labelled documents."""

import pytest
from pyspark.sql import functions as F

from markspark.operators import bucket, models
from markspark.plans import q_analysis, q_models


def _write(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")


def test_scaled_columns_from_one_pass(spark):
    df = spark.createDataFrame([(1, 2.0, 5), (2, 4.0, 5), (3, None, 5), (4, 9.0, 5)], "id int, x double, same int")
    found = bucket.scale_stats(df, ["x", "same"])
    out = bucket.zscore(bucket.minmax(df, ["x", "same"], found=found), ["x", "same"], found=found).orderBy("id").collect()
    assert out == bucket.zscore(bucket.minmax(df, ["x", "same"]), ["x", "same"]).orderBy("id").collect()
    assert [r.x_norm for r in out] == [0.0, pytest.approx(2 / 7), None, 1.0]
    assert out[0].x_std == pytest.approx(-3 / 13 ** 0.5) and out[3].x_std == pytest.approx(4 / 13 ** 0.5)
    assert {r.same_norm for r in out} == {r.same_std for r in out} == {None}


def test_delay_norm_joins_once(spark, tmp_path):
    day = F.timestamp_seconds(F.lit(86400) * F.col("id"))
    _write(spark.range(1, 9).select(F.col("id").alias("o_orderkey"), day.alias("o_orderdate")), tmp_path, "orders")
    _write(spark.range(1, 31).select(
        (F.col("id") % 9).alias("l_orderkey"), F.col("id").alias("l_partkey"), F.lit(1).cast("long").alias("l_suppkey"), F.lit(1).alias("l_linenumber"),
        (F.col("id") + 0.0).alias("l_quantity"), F.lit(0.05).alias("l_discount"), F.lit(0.0).alias("l_tax"), F.lit("R").alias("l_returnflag"),
        F.lit("O").alias("l_linestatus"), F.when(F.col("id") != 7, F.timestamp_seconds(F.lit(86400) * F.col("id") * 2)).alias("l_shipdate")), tmp_path, "lineitem")
    out = q_analysis.q_delay_norm(spark, str(tmp_path))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()  # the join was made and stored
    rows = {r.l_partkey: r for r in out.collect()}
    delay = {i: 2 * i - i % 9 for i in range(1, 31) if i % 9 and i != 7}
    lo, hi = min(delay.values()), max(delay.values())
    assert {i: r.delay_norm for i, r in rows.items()} == {i: pytest.approx((x - lo) / (hi - lo), abs=1e-8) for i, x in delay.items()}


def test_model_input_is_stored_without_its_single_columns(spark, tmp_path, monkeypatch):
    d = spark.range(60).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("Word"), F.col("id") % 3, F.lit("tail")).alias("text"),
                               F.lit("en").alias("lang"))
    _write(d, tmp_path, "documents")
    _write(d.filter("doc_id % 2 = 0").select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("quality")), tmp_path, "labels")
    _write(spark.createDataFrame([("word 0 1",)], "text string"), tmp_path, "benchmark")
    _write(spark.range(5).select(F.col("id").alias("vec_id"), F.array(*[(F.col("id") + i + 1).cast("float") for i in range(64)]).alias("embedding")), tmp_path, "embeddings")
    assert q_models.doc_vectors(spark, str(tmp_path)).count() == 60
    assert q_models.doc_vectors(spark, str(tmp_path), labelled=True).count() == 30
    stored = []
    monkeypatch.setattr(q_models, "materialize", lambda df, _of=q_models.materialize: stored.append(df) or _of(df))
    monkeypatch.setattr(models, "train_gbt", lambda train, *a, **k: train)
    train, test, names = q_models._gbt(spark, str(tmp_path))
    assert stored[0].columns == ["doc_id", "label", "features"] and train.count() + test.count() == 30
    assert len(names) == len(train.first().features) == 2 + 4 + 64
    assert train.select(F.collect_set("label")).first()[0] in ([0, 1], [1, 0])
