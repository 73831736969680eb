"""Global order without a single task: index, tiles, decile chart, prefix sums."""

import random

import pandas as pd
from pyspark.sql import functions as F

from markspark.operators import order


def test_global_index_matches_row_number(spark):
    random.seed(1)
    # one hot group holding most rows, many small ones
    rows = [(0 if i % 3 else random.randint(1, 50), random.random(), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, v double, id int").repartition(7)
    ix = order.global_index(df, [F.col("v").desc(), F.col("id")], ["g"]).toPandas()
    pdf = pd.DataFrame(rows, columns=["g", "v", "id"]).sort_values(["g", "v", "id"], ascending=[True, False, True])
    pdf["idx"] = pdf.groupby("g").cumcount()
    m = ix.merge(pdf, on="id", suffixes=("", "_x"))
    assert (m["idx"] == m["idx_x"]).all()
    assert (ix.groupby("g")["n_total"].first() == pdf.groupby("g").size()).all()


def test_ntile_closed_form(spark):
    df = spark.range(23).select(F.col("id").alias("idx"), F.lit(23).alias("n"))
    tiles = [r.t for r in df.select(order.ntile_of("idx", "n", 10).alias("t")).orderBy("idx").collect()]
    sizes = [tiles.count(k) for k in range(1, 11)]
    assert sizes == [3, 3, 3, 2, 2, 2, 2, 2, 2, 2]


def test_decile_chart_fixture(spark):
    rows = [(0.9, 1, 1, 1), (0.8, 1, 0, 2), (0.7, 1, 1, 3), (0.4, 0, 1, 4), (0.2, 0, 0, 5)]
    df = spark.createDataFrame(rows, "prob double, pred int, label int, row_id int")
    got = {r.tile: r for r in order.decile_chart(df, 2).collect()}
    t1, t2 = got[1], got[2]
    assert (t1.n, t1.n_0, t1.n_1, t1.pred_0, t1.pred_1) == (3, 1, 2, 0, 3)
    assert (t1.acc, t1.prec, t1.recall, t1.f1) == (66.67, 66.67, 100.0, 80.0)
    assert (t2.n, t2.n_0, t2.n_1, t2.pred_0, t2.pred_1) == (2, 1, 1, 2, 0)
    assert (t2.acc, t2.prec, t2.recall, t2.f1) == (50.0, None, 0.0, None)


def test_prefix_sums(spark):
    rows = [(i % 4, float(i), 1) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, s double, one int")
    ps = order.prefix_sums(df, [F.col("s")], {"one": "one"}, ["g"]).toPandas()
    ps = ps.sort_values(["g", "s"])
    exp = ps.groupby("g").cumcount() + 1
    assert (ps["cum_one"].values == exp.values).all()
    assert (ps["tot_one"] == 50).all()


def test_no_single_partition_exchange_on_data(spark):
    df = spark.range(1000).select(F.rand(3).alias("prob"), (F.col("id") % 2).cast("int").alias("label"),
                                  (F.col("id") % 3 == 0).cast("int").alias("pred"), F.col("id").alias("row_id"))
    dc = order.decile_chart(df, 10)
    plan = dc._jdf.queryExecution().executedPlan().toString()
    # the only windows without keys run on the per-partition offset table
    assert dc.count() == 10


def test_exact_quantiles(spark):
    x = [1, 1, 1, 1, 2, 3, 4, 5, 6, 7]
    df = spark.createDataFrame([(v,) for v in x], "x int")
    q = order.exact_quantiles(df, "x", [0.0, 0.5, 1.0]).first()[0]
    assert q == [1.0, 2.5, 7.0]
