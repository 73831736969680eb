"""Same rows as batch after two file drops and a restart from checkpoint."""

import datetime as dt

from markspark.operators.clean import year_between
from markspark.streaming.ingest import stream_ingest_years


def test_ingest_two_drops_and_restart(spark, tmp_path):
    schema = "id long, d timestamp_ntz"
    src, dst, ck = str(tmp_path / "src"), str(tmp_path / "dst"), str(tmp_path / "ck")
    drop1 = [(i, dt.datetime(2010 + i % 12, 1, 1)) for i in range(50)]
    drop2 = [(i, dt.datetime(2010 + i % 12, 6, 1)) for i in range(50, 120)]
    spark.createDataFrame(drop1, schema).write.mode("append").parquet(src)
    st = spark.read.parquet(src).schema
    stream_ingest_years(spark, src, dst, ck, st, "d", 2012, 2019)
    first = spark.read.parquet(dst).count()
    spark.createDataFrame(drop2, schema).write.mode("append").parquet(src)
    stream_ingest_years(spark, src, dst, ck, st, "d", 2012, 2019)  # restart from the checkpoint
    stream_ingest_years(spark, src, dst, ck, st, "d", 2012, 2019)  # nothing new: no duplicates
    got = sorted(r.id for r in spark.read.parquet(dst).collect())
    exp = sorted(r.id for r in year_between(spark.read.parquet(src), "d", 2012, 2019).collect())
    assert got == exp and first < len(got)
