"""Queries of the labelled-table path: scan, clean, dedup, label, classes,
statements, merge (S1-S4, P1-P10, J1-J6, L1-L2, A1-A9, U1-U3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markspark.operators import clean, concat, joins, label, stats
from markspark.plans import adapters as ad
from markspark.plans.oracle import CASE_CHAIN, CLASS_CHAIN, with_
from markspark.plans.registry import query
from markspark.sources.tables import load

CASE_COLS = ["serial_no", "filing_dt", "publication_dt", "registration_dt", "mark_id_char",
             "acq_dist_in", "acq_dist_part_in", "supp_reg_in"]


def cases_in_years(spark: SparkSession, sf: str, lo: int, hi: int) -> DataFrame:
    """P1 on the raw order date, so both bounds reach the Parquet scan."""
    o = clean.year_between(load(spark, sf, "orders"), "o_orderdate", lo, hi)
    return ad.cases_from(o)


def clean_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Drop null marks (P2), drop cases with designs (J1), latest per mark."""
    c = clean.drop_null(ad.cases(spark, sf), ["mark_id_char"])
    c = joins.anti(c, ad.designs(spark, sf), "serial_no")
    return clean.latest_per_key(c, "mark_id_char", "filing_dt", "serial_no")


def labelled_cases(spark: SparkSession, sf: str) -> DataFrame:
    """L1/L2/J3 over the cleaned cases."""
    return label.label_distinct(clean_cases(spark, sf), ad.office_actions(spark, sf))


def class_table(spark: SparkSession, sf: str) -> DataFrame:
    """A1 + P9: cases with exactly one class row, excluded codes dropped, int codes."""
    one = stats.exactly_one(ad.classes(spark, sf), "serial_no", "intl_class_cd")
    return clean.exclude_codes(one, "intl_class_cd", ["A", "B", "200"])


@query("year_filter", "S4 P1", with_(["cases"], """
select * from cases where filing_dt >= date '1996-01-01' and filing_dt < date '2001-01-01'"""))
def q_year_filter(spark, sf):
    return cases_in_years(spark, sf, 1996, 2000)


@query("segment_profile", "P1 A8", with_(["cases"], """
select min(filing_dt) as min_value, max(filing_dt) as max_value, count(*) as n_rows
from cases where filing_dt >= date '1996-01-01' and filing_dt < date '2001-01-01'"""))
def q_segment_profile(spark, sf):
    return stats.range_profile(cases_in_years(spark, sf, 1996, 2000), "filing_dt")


_NULL_SQL = " union all ".join(
    f"select '{c}' as column_name, cast(count_if({c} is null) as bigint) as null_count from cases"
    for c in CASE_COLS)


@query("null_profile", "A6", with_(["cases"], _NULL_SQL))
def q_null_profile(spark, sf):
    return stats.null_counts(ad.cases(spark, sf), CASE_COLS)


@query("distinct_profile", "A7 U3", """
select count(*) as n_rows,
  (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem)) as n_distinct_rows,
  count(distinct l_orderkey) as n_distinct_keys
from lineitem""")
def q_distinct_profile(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return stats.distinct_profile(li, ["l_orderkey"])


@query("date_columns", "P5 U3", with_(["cases"], """
select distinct serial_no, mark_id_char, filing_dt, publication_dt, registration_dt from cases"""))
def q_date_columns(spark, sf):
    return clean.select_like(ad.cases(spark, sf), "dt", ["serial_no", "mark_id_char"]).distinct()


@query("normalize_key", "P4", """
select try_cast(trim(key_text) as bigint) as serial_no, l_quantity from (
  select case when l_linenumber % 7 = 0 then '#' || cast(l_orderkey as varchar)
              else '  ' || cast(l_orderkey as varchar) || ' ' end as key_text, l_quantity from lineitem) t
where try_cast(trim(key_text) as bigint) is not null""")
def q_normalize_key(spark, sf):
    li = load(spark, sf, "lineitem")
    k = F.when(F.col("l_linenumber") % 7 == 0, F.concat(F.lit("#"), F.col("l_orderkey").cast("string"))) \
         .otherwise(F.concat(F.lit("  "), F.col("l_orderkey").cast("string"), F.lit(" ")))
    src = li.select(k.alias("serial_no"), "l_quantity")
    return clean.normalize_key(src, "serial_no")


@query("drop_designs", "J1 U1", with_(["cases", "designs"], """
select * from cases c where not exists (select 1 from designs d where d.serial_no = c.serial_no)"""))
def q_drop_designs(spark, sf):
    return joins.anti(ad.cases(spark, sf), ad.designs(spark, sf), "serial_no")


@query("design_overlap", "U1", with_(["cases", "designs"], """
select distinct serial_no from cases where serial_no in (select serial_no from designs)"""))
def q_design_overlap(spark, sf):
    return joins.key_intersect(ad.cases(spark, sf), ad.designs(spark, sf), "serial_no")


@query("keep_known", "J2", with_(["cases", "statements"], """
select * from statements where serial_no in (select serial_no from cases)"""))
def q_keep_known(spark, sf):
    return joins.semi(ad.statements(spark, sf), ad.cases(spark, sf), "serial_no")


@query("latest_per_mark", "P2 J1 W1", with_(["cases", "designs", "clean"], "select * from clean"))
def q_latest_per_mark(spark, sf):
    return clean_cases(spark, sf)


@query("distinct_label", "L1 L2 J3", with_(CASE_CHAIN, """
select serial_no, pub_ind, descriptive_sum, generic_sum, distinct_ind from labelled"""))
def q_distinct_label(spark, sf):
    return labelled_cases(spark, sf).select("serial_no", "pub_ind", "descriptive_sum", "generic_sum", "distinct_ind")


@query("label_incidence", "A3", with_(CASE_CHAIN, """
select distinct_ind, count(*) as n, count(*) * 100.0::double / (select count(*) from labelled) as pct
from labelled group by distinct_ind"""))
def q_label_incidence(spark, sf):
    return stats.value_counts(labelled_cases(spark, sf), "distinct_ind", normalize=True, out="pct")


@query("label_trace", "L1 (pre-final)", with_(CASE_CHAIN, """
select label_pre, count(*) as n from (
  select case when coalesce(supp_reg_in = 1, false) then 0
    when coalesce(pub_ind = 0, false) and coalesce(generic_sum, 1) <> 0 then 0
    when coalesce(pub_ind = 0, false) and coalesce(descriptive_sum, 1) <> 0 then 0
    when coalesce(pub_ind = 1, false) and coalesce(acq_dist_in = 1, false) then 0
    when coalesce(pub_ind = 0, false) and coalesce(generic_sum = 0, false) and coalesce(descriptive_sum = 0, false)
      and coalesce(supp_reg_in = 0, false) then 1
    when coalesce(pub_ind = 1, false) and coalesce(acq_dist_in = 0, false) then 1
    else -1 end as label_pre from labelled) t
group by label_pre"""))
def q_label_trace(spark, sf):
    lab = labelled_cases(spark, sf).withColumn("label_pre", label.label_trace())
    return stats.group_count(lab, ["label_pre"])


@query("office_action_rate", "A5 J3", with_(CASE_CHAIN, """
select round_even(100.0::double * count(generic_sum) / count(*), 2) as match_pct from labelled"""))
def q_office_action_rate(spark, sf):
    return stats.match_rate(labelled_cases(spark, sf), "generic_sum")


@query("single_class", "A1", with_(["classes", "single_class"], "select * from single_class"))
def q_single_class(spark, sf):
    return stats.exactly_one(ad.classes(spark, sf), "serial_no", "intl_class_cd")


@query("exclude_class", "A1 P9", with_(CLASS_CHAIN, "select * from class_int"))
def q_exclude_class(spark, sf):
    return class_table(spark, sf)


@query("statement_concat", "A2", with_(["statements", "stmt_concat"], "select * from stmt_concat"))
def q_statement_concat(spark, sf):
    return stats.concat_text(ad.statements(spark, sf), "serial_no", "statement_text", "seq")


TRANSCRIPT_CHARS = 16_384


@query("role_transcripts", "A2", with_(["statements"], f"""
select statement_type_cd, place // {TRANSCRIPT_CHARS} as segment, cast(min(place) as bigint) as start,
  string_agg(statement_text, ' ' order by place) as statement_text
from (select statement_type_cd, statement_text, cast(coalesce(sum(length(statement_text) + 1) over (partition by statement_type_cd
    order by serial_no nulls first, seq nulls first, statement_text rows between unbounded preceding and 1 preceding), 0) as bigint) as place
  from statements where statement_text is not null)
group by statement_type_cd, place // {TRANSCRIPT_CHARS}"""))
def q_role_transcripts(spark, sf):
    """All statements of a role in one text: a few keys hold all rows, so the text comes in segments."""
    return concat.concat_segments(ad.statements(spark, sf), "statement_type_cd", "statement_text", ["serial_no", "seq"], TRANSCRIPT_CHARS)


@query("prefix_split_concat", "P10 A2", with_(["statements"], """
select 'pm' as part, serial_no, string_agg(statement_text, ' ' order by seq) as statement_text
from statements where coalesce(starts_with(trim(statement_type_cd), 'sys'), false) group by serial_no
union all
select 'no_pm' as part, serial_no, string_agg(statement_text, ' ' order by seq) as statement_text
from statements where not coalesce(starts_with(trim(statement_type_cd), 'sys'), false) group by serial_no"""))
def q_prefix_split_concat(spark, sf):
    pm, rest = clean.split_by_prefix(ad.statements(spark, sf), "statement_type_cd", "sys")
    a = stats.concat_text(pm, "serial_no", "statement_text", "seq").withColumn("part", F.lit("pm"))
    b = stats.concat_text(rest, "serial_no", "statement_text", "seq").withColumn("part", F.lit("no_pm"))
    return joins.union_all([a, b]).select("part", "serial_no", "statement_text")


def merged(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled cases x single class x concatenated statements (inner)."""
    lab = labelled_cases(spark, sf).select("serial_no", "filing_dt", "mark_id_char", "acq_dist_in",
                                           "acq_dist_part_in", "pub_ind", "distinct_ind")
    st = stats.concat_text(ad.statements(spark, sf), "serial_no", "statement_text", "seq")
    return joins.join_all([lab, class_table(spark, sf), st], "serial_no")


MERGED_SQL = """
select l.serial_no, l.filing_dt, l.mark_id_char, l.acq_dist_in, l.acq_dist_part_in, l.pub_ind, l.distinct_ind,
  c.intl_class_cd, s.statement_text
from labelled l join class_int c on l.serial_no = c.serial_no join stmt_concat s on l.serial_no = s.serial_no"""


@query("merged_cases", "J4", with_(CASE_CHAIN + CLASS_CHAIN + ["statements", "stmt_concat"], MERGED_SQL))
def q_merged_cases(spark, sf):
    return merged(spark, sf)


@query("time_split_rates", "P1 P2 J1 W1 L1 P11 A4", with_(CASE_CHAIN, """
select split, count(*) as n, cast(sum(distinct_ind) as bigint) as n_pos,
  100.0::double * sum(distinct_ind) / count(*) as incidence
from (select *, case when filing_dt <= date '1999-12-31' then 'train'
                     when filing_dt <= date '2000-12-31' then 'val'
                     when filing_dt > date '2000-12-31' and filing_dt <= date '2001-12-31' then 'test' end as split
      from labelled) t group by split"""))
def q_time_split_rates(spark, sf):
    lab = clean.time_split(labelled_cases(spark, sf), "filing_dt", "1999-12-31", "2000-12-31", "2001-12-31")
    return stats.incidence_rate(lab, "distinct_ind", ["split"])


@query("composite_join", "J6", with_(["cases", "translations"], """
select c.serial_no, c.filing_dt, c.mark_id_char, t.mark_translated
from cases c join translations t on c.serial_no = t.serial_no and c.filing_dt = t.filing_dt"""))
def q_composite_join(spark, sf):
    c = ad.cases(spark, sf).select("serial_no", "filing_dt", "mark_id_char")
    return c.join(ad.translations(spark, sf), ["serial_no", "filing_dt"], "inner")


@query("drop_nulls", "P2 P3", with_(["cases"], """
select * from cases where serial_no is not null and filing_dt is not null and publication_dt is not null
  and registration_dt is not null and mark_id_char is not null and acq_dist_in is not null
  and acq_dist_part_in is not null and supp_reg_in is not null"""))
def q_drop_nulls(spark, sf):
    c = clean.drop_null(ad.cases(spark, sf), ["mark_id_char"])
    return clean.drop_any_null(c)


@query("rename_drop", "P6 P7", with_(["cases"], """
select serial_no, filing_dt as filed, mark_id_char as mark, acq_dist_in, supp_reg_in from cases"""))
def q_rename_drop(spark, sf):
    c = clean.drop_columns(ad.cases(spark, sf), ["publication_dt", "registration_dt", "acq_dist_part_in"])
    return clean.rename(c, {"filing_dt": "filed", "mark_id_char": "mark"})
