"""The registered queries against DuckDB at sf0.001, and the pipeline's stages against what they promise."""

import os

import pytest
from scripts.check_oracle import rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_line_dedup", "op3_decontamination", "op4_topk", "op7_near_dup"])
def test_query_equals_duckdb(spark, name):
    import duckdb

    from markspark.llm import queries
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).to_arrow_table()
    got = queries.queries()[name](spark, SF).toArrow()
    assert rows(got, 6) == rows(want, 6)


def test_pipeline(spark):
    import corpus_pipeline as p
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in p.STAGES]
    assert names == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "bpe_encoding"]
    before, columns = docs.count(), docs.columns
    for name, stage in p.STAGES[:-1]:
        docs = p.stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
        after = docs.count()
        assert after <= before and after > 0.5 * before and (name != "line_dedup" or after == before)
        before = after
    last = p.STAGES[-1][1](spark, docs, SF)
    assert last.count() == before and {"doc_id", "n_tokens", "ids"} <= set(last.columns)
    assert p.run(spark, SF).count() == before
    assert os.path.exists(SF)
