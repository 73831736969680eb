"""Text queries: cleaning, word counts, lexicon and translation lookups,
model-input assembly and token containment (F1-F11, F20, P8, J5, J9, J11,
J12, L3, S10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markspark.functions import templates, text
from markspark.operators import clean, joins, label, stats
from markspark.plans import adapters as ad
from markspark.plans.oracle import CASE_CHAIN, CLASS_CHAIN, CTE, with_
from markspark.plans.q_cases import MERGED_SQL, merged
from markspark.plans.registry import query
from markspark.sources.tables import load

PUNCT = r"[^\p{L}\p{N}_\s]"


@query("clean_text", "F1 F2 F3", f"""
select doc_id, regexp_replace(lower(text), '{PUNCT}', '', 'g') as text_clean,
  regexp_replace(text, '{PUNCT}', '', 'g') as text_stripped,
  cast(len(list_filter(regexp_split_to_array(regexp_replace(text, '{PUNCT}', '', 'g'), '\\s+'), lambda x: x <> '')) as integer) as n_words
from documents""")
def q_clean_text(spark, sf):
    d = load(spark, sf, "documents")
    return d.select("doc_id", text.clean_lower("text").alias("text_clean"),
                    text.strip_punct("text").alias("text_stripped"),
                    text.word_count(text.strip_punct("text")).alias("n_words"))


@query("word_count_filter", "F2 F3 P8", f"""
select doc_id, n_words from (
  select doc_id, cast(len(list_filter(regexp_split_to_array(regexp_replace(text, '{PUNCT}', '', 'g'), '\\s+'),
                                 lambda x: x <> '')) as integer) as n_words from documents) t
where n_words between 1 and 4""")
def q_word_count_filter(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", text.strip_punct("text").alias("t"))
    return clean.mark_length_filter(d, "t", 1, 4, "n_words").select("doc_id", "n_words")


@query("lexicon_flag", "J11 A5", with_(["lexicon"], """
select d.doc_id, coalesce(h.wn_ind, 0) as wn_ind from documents d left join (
  select distinct doc_id, 1 as wn_ind from (
    select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) as token
    from documents) t where token in (select token from lexicon)) h on d.doc_id = h.doc_id"""))
def q_lexicon_flag(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "text")
    return joins.lexicon_indicator(d, "doc_id", "text", ad.lexicon(spark, sf)).select("doc_id", "wn_ind")


_FORMS = ", ".join(["t"] + [f"case when ends_with(t, '{a}') and len(t) > {len(a)} then substr(t, 1, len(t) - {len(a)}) || '{b}' end"
                            for a, b in joins.ENGLISH_FORMS])


@query("lexicon_forms", "J11", with_(["lexicon"], f"""
select d.doc_id, cast(d.doc_id in (
  select doc_id from (select doc_id, unnest([{_FORMS}]) as token from (
    select doc_id, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(text, '{PUNCT}', '', 'g')), '\\s+'), lambda x: x <> '')) as t
    from documents where doc_id is not null) w) f where token in (select token from lexicon)) as integer) as wn_ind
from documents d"""))
def q_lexicon_forms(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", text.strip_punct("text").alias("text"))
    return joins.lexicon_indicator(d, "doc_id", "text", ad.lexicon(spark, sf), rules=joins.ENGLISH_FORMS).select("doc_id", "wn_ind")


def translated(spark: SparkSession, sf: str) -> DataFrame:
    """Cases with their final mark (sentinel keeps the processed mark)."""
    c = (ad.cases(spark, sf).select("serial_no", "filing_dt", "mark_id_char")
         .withColumn("mark_processed", text.strip_punct("mark_id_char")))
    return joins.apply_translation(c, ad.translations(spark, sf), ["serial_no", "filing_dt"]).drop("mark_processed")


CTE["translated"] = f"""
select c.serial_no, c.filing_dt, c.mark_id_char, t.mark_translated,
  case when t.mark_translated = '-1' then regexp_replace(c.mark_id_char, '{PUNCT}', '', 'g') else t.mark_translated end as mark_final
from cases c join translations t on c.serial_no = t.serial_no and c.filing_dt = t.filing_dt"""


@query("translate_marks", "J12 J6", with_(["cases", "translations", "translated"], "select * from translated"))
def q_translate_marks(spark, sf):
    return translated(spark, sf)


CTE["translated_text"] = f"""
select serial_no, mark_final,
  cast(not coalesce(lower(trim(regexp_replace(mark_id_char, '{PUNCT}', '', 'g'))) = lower(trim(mark_final)), false) as double)
    as translated_ind,
  case when not coalesce(lower(trim(regexp_replace(mark_id_char, '{PUNCT}', '', 'g'))) = lower(trim(mark_final)), false)
    then mark_final else 'no translation required' end as mark_translated
from translated"""


@query("translated_text", "L3 F2", with_(["cases", "translations", "translated", "translated_text"],
                                          "select * from translated_text"))
def q_translated_text(spark, sf):
    t = translated(spark, sf).withColumn("mark_processed", text.strip_punct("mark_id_char"))
    ind, txt = label.translation_text("mark_processed", "mark_final")
    return t.select("serial_no", "mark_final", ind.alias("translated_ind"), txt.alias("mark_translated"))


def statement_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """P10 + A2: pseudo marks and the remaining statements per case, each as
    processed (F1) and unprocessed concatenations."""
    st = ad.statements(spark, sf).withColumn("statement_processed", text.clean_lower("statement_text"))
    pm, rest = clean.split_by_prefix(st, "statement_type_cd", "sys")

    def agg(df, p_out, u_out):
        return stats.concat_texts(df, "serial_no", {p_out: "statement_processed", u_out: "statement_text"}, "seq")
    return (agg(pm, "pseudo_mark_processed", "pseudo_mark_unprocessed"),
            agg(rest, "statement_processed", "statement_unprocessed"))


def model_table(spark: SparkSession, sf: str) -> DataFrame:
    """J5 chain: marks + translation + class description + pseudo marks +
    statements, null rows dropped, indicator texts and both model inputs."""
    m = merged(spark, sf).select("serial_no", "filing_dt", "mark_id_char", "distinct_ind", "intl_class_cd")
    m = (m.withColumn("mark_unprocessed", F.col("mark_id_char"))
          .withColumn("mark_processed", text.strip_punct("mark_id_char")))
    m = clean.mark_length_filter(m, "mark_processed", filter=False)
    m = joins.lexicon_indicator(m, "serial_no", "mark_processed", ad.lexicon(spark, sf))
    m = joins.left_lookup(m, translated(spark, sf).select("serial_no", "mark_final"), "serial_no")
    ind, txt = label.translation_text("mark_processed", "mark_final")
    m = m.withColumn("translated_ind", ind).withColumn("mark_translated", txt)
    nice = ad.nice_descriptions(spark, sf).select(
        F.col("Class").alias("intl_class_cd"),
        text.clean_lower("Description").alias("nice_description_preprocessed"),
        F.col("Description").alias("nice_description_unpreprocessed"))
    m = joins.left_lookup(m, nice, "intl_class_cd", broadcast="bounded")  # one row per class code
    pm, rest = statement_parts(spark, sf)
    m = joins.left_lookup(m, pm, "serial_no")
    m = (m.withColumn("pseudo_mark_processed", text.pseudo_mark_text("pseudo_mark_processed"))
          .withColumn("pseudo_mark_unprocessed", text.pseudo_mark_text("pseudo_mark_unprocessed")))
    m = joins.left_lookup(m, rest, "serial_no")
    m = clean.drop_any_null(m)
    m = (m.withColumn("wordnet_text", text.flag_text("wn_ind", "mark present in Wordnet", "mark absent in Wordnet"))
          .withColumn("mark_length_text", text.indicator_text("mark_len", "mark length is "))
          .withColumn("nice_cat_text", text.indicator_text("intl_class_cd", "NICE category is ")))
    return (m.withColumn("bert_input_processed", templates.model_input("full", "cls", True))
             .withColumn("bert_input_unprocessed", templates.model_input("full", "cls", False)))


CTE["pm_rest"] = f"""
select serial_no, seq, statement_type_cd, statement_text,
  regexp_replace(lower(statement_text), '{PUNCT}', '', 'g') as statement_processed,
  coalesce(starts_with(trim(statement_type_cd), 'sys'), false) as is_pm
from statements"""

CTE["model_base"] = f"""
select m.serial_no, m.filing_dt, m.mark_id_char, m.distinct_ind, m.intl_class_cd,
  m.mark_id_char as mark_unprocessed, regexp_replace(m.mark_id_char, '{PUNCT}', '', 'g') as mark_processed
from ({MERGED_SQL}) m"""

CTE["model_full"] = f"""
select * from (
  select b.*, cast(len(list_filter(regexp_split_to_array(b.mark_processed, '\\s+'), lambda x: x <> '')) as integer) as mark_len,
    case when exists (select 1 from (select unnest(list_filter(regexp_split_to_array(lower(b.mark_processed), '\\s+'),
        lambda x: x <> '')) as token) tk where tk.token in (select token from lexicon)) then 1 else 0 end as wn_ind,
    tr.mark_final,
    cast(not coalesce(lower(trim(b.mark_processed)) = lower(trim(tr.mark_final)), false) as double) as translated_ind,
    case when not coalesce(lower(trim(b.mark_processed)) = lower(trim(tr.mark_final)), false) then tr.mark_final
      else 'no translation required' end as mark_translated,
    regexp_replace(lower(n.Description), '{PUNCT}', '', 'g') as nice_description_preprocessed,
    n.Description as nice_description_unpreprocessed,
    coalesce('Pseudo mark is ' || pm.p, 'no Pseudo mark') as pseudo_mark_processed,
    coalesce('Pseudo mark is ' || pm.u, 'no Pseudo mark') as pseudo_mark_unprocessed,
    st.p as statement_processed, st.u as statement_unprocessed
  from model_base b
  left join translated tr on b.serial_no = tr.serial_no
  left join nice n on b.intl_class_cd = n.Class
  left join (select serial_no, string_agg(statement_processed, ' ' order by seq) as p,
                    string_agg(statement_text, ' ' order by seq) as u
             from pm_rest where is_pm group by serial_no) pm on b.serial_no = pm.serial_no
  left join (select serial_no, string_agg(statement_processed, ' ' order by seq) as p,
                    string_agg(statement_text, ' ' order by seq) as u
             from pm_rest where not is_pm group by serial_no) st on b.serial_no = st.serial_no
) x
where columns(*) is not null"""

CTE["model_text"] = """
select *, case when wn_ind = 1 then 'mark present in Wordnet' else 'mark absent in Wordnet' end as wordnet_text,
  'mark length is ' || cast(mark_len as varchar) as mark_length_text,
  'NICE category is ' || cast(intl_class_cd as varchar) as nice_cat_text
from model_full"""

MODEL_CHAIN = CASE_CHAIN + CLASS_CHAIN + ["statements", "stmt_concat", "lexicon", "translations", "translated",
                                          "nice", "pm_rest", "model_base", "model_full", "model_text"]

_P = ["mark_processed", "statement_processed", "mark_translated", "wordnet_text", "mark_length_text",
      "nice_cat_text", "nice_description_preprocessed", "pseudo_mark_processed"]
_U = ["mark_unprocessed", "statement_unprocessed", "mark_translated", "wordnet_text", "mark_length_text",
      "nice_cat_text", "nice_description_unpreprocessed", "pseudo_mark_unprocessed"]


def _sql_join(cols, begin="[CLS] ", sep=" [SEP] "):
    return f"'{begin}' || " + f" || '{sep}' || ".join(cols)


@query("model_input", "F4 F5 F10 J5 S10 L3 J11 J12", with_(MODEL_CHAIN, f"""
select serial_no, distinct_ind, {_sql_join(_P)} as bert_input_processed,
  {_sql_join(_U)} as bert_input_unprocessed from model_text"""))
def q_model_input(spark, sf):
    return model_table(spark, sf).select("serial_no", "distinct_ind", "bert_input_processed", "bert_input_unprocessed")


@query("model_input_pieces", "F4 F10 L3 J5", with_(MODEL_CHAIN, """
select serial_no, mark_len, wn_ind, translated_ind, mark_translated, wordnet_text, mark_length_text, nice_cat_text,
  nice_description_preprocessed, pseudo_mark_processed, pseudo_mark_unprocessed from model_text"""))
def q_model_input_pieces(spark, sf):
    return model_table(spark, sf).select(
        "serial_no", "mark_len", "wn_ind", "translated_ind", "mark_translated", "wordnet_text", "mark_length_text",
        "nice_cat_text", "nice_description_preprocessed", "pseudo_mark_processed", "pseudo_mark_unprocessed")


@query("model_input_s_tags", "F5 (second marker style)", with_(MODEL_CHAIN, f"""
select serial_no, {_sql_join(_P, '<s> ', ' </s> ')} as s_tag_input_processed from model_text"""))
def q_model_input_s_tags(spark, sf):
    return model_table(spark, sf).select(
        "serial_no", templates.model_input("full", "s_tag", True).alias("s_tag_input_processed"))


@query("model_input_mark_only", "F7", with_(MODEL_CHAIN, """
select serial_no, '[CLS] ' || mark_unprocessed as bert_input_only_mark from model_text"""))
def q_model_input_mark_only(spark, sf):
    return model_table(spark, sf).select(
        "serial_no", templates.model_input("only_mark", "cls", False).alias("bert_input_only_mark"))


@query("model_input_wo_mark", "F7", with_(MODEL_CHAIN, f"""
select serial_no, {_sql_join(_U[1:])} as bert_input_wo_mark from model_text"""))
def q_model_input_wo_mark(spark, sf):
    return model_table(spark, sf).select(
        "serial_no", templates.model_input("wo_mark", "cls", False).alias("bert_input_wo_mark"))


_SHUF = " union all ".join(
    f"select serial_no, {i} as pos, {c} as seg from model_text" for i, c in enumerate(_U))


@query("model_input_shuffled", "F8", with_(MODEL_CHAIN, f"""
select serial_no, '[CLS] ' || string_agg(seg, ' [SEP] ' order by h, seg) as bert_input_shuffled from (
  select serial_no, seg,
    ('0x' || substr(md5(concat_ws('|', '42', cast(serial_no as varchar), cast(pos as varchar))), 1, 8))::bigint as h
  from ({_SHUF}) u) t group by serial_no"""))
def q_model_input_shuffled(spark, sf):
    return model_table(spark, sf).select(
        "serial_no", templates.model_input("shuffled", "cls", False, seed=42, key="serial_no").alias("bert_input_shuffled"))


_PUNCT_SQL = text.ASCII_PUNCT.replace("'", "''")


@query("token_match", "F11 F20 J9", f"""
select w.word, d.doc_id from (
  select distinct translate(token, '{_PUNCT_SQL}', '') as word from (
    select unnest(regexp_split_to_array(lower(text), '\\s+')) as token from benchmark) a
  where translate(token, '{_PUNCT_SQL}', '') <> '') w
join (select distinct doc_id, tok from (select doc_id, unnest(string_split(text, ' ')) as tok from documents) x) d
  on d.tok = w.word""")
def q_token_match(spark, sf):
    b = load(spark, sf, "benchmark")
    words = (b.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("t"))
              .select(text.strip_ascii_punct("t").alias("word")).filter("word <> ''").distinct())
    d = load(spark, sf, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("tok")).distinct()
    return words.join(d, words.word == d.tok).select("word", "doc_id")


@query("marker_strip", "F9", with_(MODEL_CHAIN, f"""
select serial_no, replace(replace({_sql_join(_P)}, '[SEP]', ''), '[CLS]', '') as text_plain from model_text"""))
def q_marker_strip(spark, sf):
    m = model_table(spark, sf)
    return m.select("serial_no", text.strip_markers("bert_input_processed").alias("text_plain"))
