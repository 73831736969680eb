"""Every registered query against its DuckDB oracle on the smallest test data."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    from check_oracle import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def _names():
    import __spark_entry__ as E
    return sorted(E.queries())


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    from check_oracle import rows
    st = E.queries()[name](spark, SF).toArrow()
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert st.num_rows >= 0
        return
    dt = duck.sql(sql).to_arrow_table()
    sc, sr = rows(st, 6)
    dc, dr = rows(dt, 6)
    assert sc == dc
    assert sr == dr


def test_entry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "incidence" in df.columns
