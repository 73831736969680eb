"""Source/sink round trips, run-file concatenation, streaming ingest and the
quality checks (S1-S10, R1, Q1-Q5).

Files go to a fresh folder under the shared checkpoint directory named by
``spark.checkpoint.dir`` (never a machine-local temp folder).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, LongType, StringType, StructField, StructType

from markspark.operators import checks, explain
from markspark.plans import adapters as ad
from markspark.plans import q_attr  # noqa: F401  (SQL pieces of the sub-word tables)
from markspark.plans.oracle import CASE_CHAIN, CLASS_CHAIN, with_
from markspark.plans.q_analysis import court_mt
from markspark.plans.q_cases import class_table, labelled_cases
from markspark.plans.registry import query
from markspark.session import checkpoint_dir
from markspark.sources import tables
from markspark.streaming.ingest import stream_ingest_years

CASE_SCHEMA = StructType([
    StructField("serial_no", LongType()), StructField("filing_dt", DateType()),
    StructField("publication_dt", DateType()), StructField("registration_dt", DateType()),
    StructField("mark_id_char", StringType()), StructField("acq_dist_in", IntegerType()),
    StructField("acq_dist_part_in", IntegerType()), StructField("supp_reg_in", IntegerType()),
])


def scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/markspark-io/{name}-{uuid.uuid4().hex}"


@query("csv_roundtrip", "S1 S3 S6", with_(["cases"], """
select serial_no, filing_dt, publication_dt, mark_id_char from cases"""))
def q_csv_roundtrip(spark, sf):
    path = scratch(spark, "cases-csv")
    tables.write_report(ad.cases(spark, sf), path, single_file=False)
    return tables.read_table(spark, path, CASE_SCHEMA, ["serial_no", "filing_dt", "publication_dt", "mark_id_char"])


@query("stage_roundtrip", "S4 S5", with_(CASE_CHAIN, "select serial_no, pub_ind, distinct_ind from labelled"))
def q_stage_roundtrip(spark, sf):
    path = scratch(spark, "labelled")
    tables.write_stage(labelled_cases(spark, sf), path)
    return tables.read_stage(spark, path, ["serial_no", "pub_ind", "distinct_ind"])


@query("class_roundtrip", "S7 S9", with_(CLASS_CHAIN, """
select serial_no, intl_class_cd from class_int where intl_class_cd in (9, 16)"""))
def q_class_roundtrip(spark, sf):
    path = scratch(spark, "by-class")
    tables.write_by_class(class_table(spark, sf), path, "intl_class_cd")
    return tables.read_classes(spark, path, [9, 16], "intl_class_cd").select("serial_no", "intl_class_cd")


@query("run_concat", "S8 U2", with_(["scored"], f"""
select 'run_' || l_linestatus as run, l_orderkey, l_partkey, l_suppkey, l_linenumber, label, prob from scored"""))
def q_run_concat(spark, sf):
    base = scratch(spark, "runs")
    s = ad.scored(spark, sf).select(*ad.SCORE_KEY, "label", "prob", "l_linestatus")
    # one pass writes a folder for each run, whatever statuses there are
    tables.write_by_class(s.withColumn("run_of", F.concat(F.lit("run_"), "l_linestatus")).drop("l_linestatus"), f"{base}/all", "run_of")
    tables.write_stage(s.limit(0).drop("l_linestatus"), f"{base}/other_X")  # must not be read
    r = tables.read_runs(spark, f"{base}/all/run_of=run_*", pattern="*.parquet", expect_n=s.count(), run_col="run", level=-2)
    r = r.withColumn("run", F.substring_index("run", "=", -1))
    return r.select("run", *ad.SCORE_KEY, "label", "prob")


@query("stream_ingest", "R1 P1", with_(["cases"], """
select * from cases where filing_dt >= date '1996-01-01' and filing_dt < date '2001-01-01'"""))
def q_stream_ingest(spark, sf):
    schema = tables.load(spark, sf, "orders").schema
    dst, ck = scratch(spark, "ingest-out"), scratch(spark, "ingest-ckpt")
    stream_ingest_years(spark, sf, dst, ck, schema, "o_orderdate", 1996, 2000, file_glob="orders.parquet")
    return ad.cases_from(spark.read.schema(schema).parquet(dst))


@query("quality_checks", "Q1 Q2 Q3 Q4 Q5", with_(["scored", "oa", "court", "court_mt", "texts", "pieces", "words",
                                                    "merged_words"], """
select 'expect_rows' as check_name, cast(abs(count(*) - (select count(*) from lineitem)) as bigint) as failures,
  abs(count(*) - (select count(*) from lineitem)) = 0 as ok from scored
union all
select 'expect_unique', cast(count(*) as bigint), count(*) = 0 from (select serial_no from oa group by serial_no having count(*) > 1) d
union all
select 'expect_equal_columns', cast(count_if(s.label is distinct from
    cast(l.l_returnflag in ('R', 'A') and l.l_quantity >= 20.0::double as integer)) as bigint),
  count_if(s.label is distinct from cast(l.l_returnflag in ('R', 'A') and l.l_quantity >= 20.0::double as integer)) = 0
from scored s join lineitem l on s.l_orderkey = l.l_orderkey and s.l_partkey = l.l_partkey
  and s.l_suppkey = l.l_suppkey and s.l_linenumber = l.l_linenumber
union all
select 'expect_single_value', cast(count_if(k > 1) as bigint), count_if(k > 1) = 0 from (
  select mark_type, count(distinct distinct_ind) as k from court_mt group by mark_type) g
union all
select 'expect_full_alignment', cast(count_if(n_words <> coalesce(n_scored, 0)) as bigint), count_if(n_words <> coalesce(n_scored, 0)) = 0
from (select t.doc_id, len(list_filter(regexp_split_to_array(t.text, '\\s+'), lambda x: x <> '')) as n_words, s.n_scored
      from texts t left join (select doc_id, count(*) as n_scored from merged_words group by doc_id) s
      on t.doc_id = s.doc_id) x"""))
def q_quality_checks(spark, sf):
    li = tables.load(spark, sf, "lineitem")
    s = ad.scored(spark, sf)
    q1 = checks.expect_rows(s, li.count())
    q2 = checks.expect_unique(ad.office_actions(spark, sf), ["serial_no"])
    recomputed = li.select(*ad.SCORE_KEY, (F.col("l_returnflag").isin("R", "A") & (F.col("l_quantity") >= F.lit(20.0)))
                           .cast("int").alias("label_check"))
    q3 = checks.expect_equal_columns(s.join(recomputed, ad.SCORE_KEY), "label", "label_check")
    q4 = checks.expect_single_value(court_mt(spark, sf), ["mark_type"], "distinct_ind")
    texts, pieces = ad.subword_pieces(spark, sf)
    q5 = checks.expect_full_alignment(explain.alignment_counts(explain.merge_subwords(pieces, texts), texts),
                                      "n_words", "n_scored")
    out = q1
    for q in (q2, q3, q4, q5):
        out = out.unionByName(q)
    return out


@query("segment_ingest", "S2 S3 P1", with_(["cases"], """
select * from cases where filing_dt >= date '2000-01-01' and filing_dt < date '2002-01-01'"""))
def q_segment_ingest(spark, sf):
    orders = tables.load(spark, sf, "orders")
    src, dst = scratch(spark, "orders-csv"), scratch(spark, "orders-2000-2001")
    orders.write.option("header", True).csv(src)  # the extract as CSV files
    tables.ingest_years(spark, src, dst, orders.schema, "o_orderdate", 2000, 2001)
    return ad.cases_from(tables.read_table(spark, dst, orders.schema))
