"""Word-attribution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from markspark.operators import attribution, explain, models, order, stats
from markspark.plans import adapters as ad
from markspark.plans.oracle import CTE, with_
from markspark.plans.registry import query
from markspark.plans.sqlkit import r9, sr9
from markspark.sources.tables import load

CTE["texts"] = "select p_partkey as doc_id, p_name as text from part"
CTE["pieces"] = """
select doc_id, pos, piece, case when piece = '' then 0.0::double
  else ((('0x' || substr(md5(concat_ws('|', cast(doc_id as varchar), cast(pos as varchar))), 1, 8))::bigint % 1000)::double
        / 1000.0::double - 0.5::double) end as score
from (
  select doc_id, wp * 100 + cp + 1 as pos,
    case when cp = nc - 1 and wp < nw - 1 then c || ' ' else c end as piece
  from (select doc_id, wp, nw, unnest(ch) as c, generate_subscripts(ch, 1) - 1 as cp, len(ch) as nc
        from (select doc_id, w, wp, nw, regexp_extract_all(w, '.{1,3}') as ch
              from (select doc_id, unnest(string_split(text, ' ')) as w,
                           generate_subscripts(string_split(text, ' '), 1) - 1 as wp,
                           len(string_split(text, ' ')) as nw from texts) a) b) c
  union all select doc_id, 0 as pos, '' as piece from texts
  union all select doc_id, 1000000 as pos, '' as piece from texts) u"""
CTE["words"] = """
select doc_id, word_pos, word,
  sum(length(word)) over (partition by doc_id order by word_pos rows between unbounded preceding and current row) as w_end
from (select doc_id, unnest(tk) as word, generate_subscripts(tk, 1) - 1 as word_pos
      from (select doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as tk from texts) t) u"""
CTE["merged_words"] = """
select w.doc_id, w.word_pos, w.word, g.score, g.n_pieces from words w join (
  select doc_id, widx as word_pos, avg(sc) as score, count(*) as n_pieces from (
    select doc_id, kind, sc, sum(1 - kind) over (partition by doc_id order by off, kind, ord
                                                 rows between unbounded preceding and current row) as widx
    from (select doc_id, w_end as off, 0 as kind, word_pos as ord, null::double as sc from words
          union all
          select doc_id, coalesce(sum(length(regexp_replace(piece, '\\s', '', 'g'))) over (partition by doc_id order by pos
                 rows between unbounded preceding and 1 preceding), 0) as off, 1 as kind, pos as ord, score as sc
          from pieces where piece <> ' ') e) r
  where kind = 1 group by doc_id, widx) g on w.doc_id = g.doc_id and w.word_pos = g.word_pos"""
CTE["word_class"] = """
select m.*, p.p_size as class from merged_words m join part p on m.doc_id = p.p_partkey"""
CTE["word_attr"] = """
select class, word, avg(score) as attr, count(*) as freq from word_class group by class, word"""
ATTR = ["texts", "pieces", "words", "merged_words"]


def merged_words(spark, sf):
    texts, pieces = ad.subword_pieces(spark, sf)
    return explain.merge_subwords(pieces, texts)


def word_attr(spark, sf):
    m = merged_words(spark, sf)
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").alias("class"))
    return stats.word_attribution_mean(m.join(p, "doc_id"), ["class"], "word", "score")


@query("subword_merge", "X1", with_(ATTR, f"""
select doc_id, cast(word_pos as integer) as word_pos, word, {r9('score')} as score, n_pieces from merged_words"""))
def q_subword_merge(spark, sf):
    m = merged_words(spark, sf)
    return m.select("doc_id", "word_pos", "word", sr9(F.col("score")).alias("score"), "n_pieces")


@query("word_attr_mean", "A15 X3", with_(ATTR + ["word_class", "word_attr"], f"""
select class, word, {r9('attr')} as attr, freq from word_attr"""))
def q_word_attr_mean(spark, sf):
    a = word_attr(spark, sf)
    return a.select("class", "word", sr9(F.col("attr")).alias("attr"), "freq")


@query("word_attr_topk", "W13", with_(ATTR + ["word_class", "word_attr"], f"""
select class, word, {r9('attr')} as attr, cast(rank as integer) as rank from (
  select *, row_number() over (partition by class order by attr desc, word) as rank from word_attr) t where rank <= 10"""))
def q_word_attr_topk(spark, sf):
    t = order.topk(word_attr(spark, sf), ["class"], "attr", 10, key=["word"])
    return t.select("class", "word", sr9(F.col("attr")).alias("attr"), "rank")


@query("topk_marks", "X4 J9 W13", with_(ATTR + ["word_class", "word_attr"], f"""
select t.class, t.word, {r9('t.attr')} as attr, cast(t.rank as integer) as rank, m.row_id from (
  select *, row_number() over (partition by class order by attr desc, word) as rank from word_attr) t
left join (select distinct class, row_id, word from (
        select p_size as class, p_partkey as row_id, unnest(regexp_split_to_array(p_name, '\\s+')) as word from part) x) m
  on t.class = m.class and t.word = m.word
where t.rank <= 3"""))
def q_topk_marks(spark, sf):
    marks = load(spark, sf, "part").select(F.col("p_size").alias("class"), F.col("p_partkey").alias("row_id"),
                                          F.col("p_name").alias("mark"))
    t = explain.topk_with_marks(word_attr(spark, sf), marks, "class", "word", "attr", 3, "row_id", "mark")
    return t.select("class", "word", sr9(F.col("attr")).alias("attr"), "rank", "row_id")


@query("topk_share", "W14", with_(ATTR, f"""
select doc_id, word, {r9('score')} as score, {r9('score * 100.0::double / nullif(total, 0)')} as share,
  cast(rank as integer) as rank from (
  select *, sum(score) over (partition by doc_id) as total,
    row_number() over (partition by doc_id order by score desc, word) as rank from merged_words) t
where rank <= 5"""))
def q_topk_share(spark, sf):
    t = order.topk_share(merged_words(spark, sf), "doc_id", "word", "score", 5)
    return t.select("doc_id", "word", sr9(F.col("score")).alias("score"), sr9(F.col("share")).alias("share"), "rank")


@query("word_weights", "X5", with_(ATTR + ["word_class", "word_attr"], f"""
select class, word, {r9('-attr')} as weight from word_attr where -attr > 0"""))
def q_word_weights(spark, sf):
    w = explain.word_weights(word_attr(spark, sf), sign=-1)
    return w.select("class", "word", sr9(F.col("weight")).alias("weight"))


@query("doc_minmax", "W16", with_(ATTR, f"""
select doc_id, cast(word_pos as integer) as word_pos,
  {r9('(score - min(score) over (partition by doc_id)) / nullif(max(score) over (partition by doc_id) - min(score) over (partition by doc_id), 0)')}
  as scaled from merged_words"""))
def q_doc_minmax(spark, sf):
    d = order.doc_minmax(merged_words(spark, sf), "doc_id", "score")
    return d.select("doc_id", "word_pos", sr9(F.col("scaled")).alias("scaled"))


@query("alignment_check", "Q5", with_(["texts", "pieces", "words", "merged_words"], """
select cast(count_if(n_words <> coalesce(n_scored, 0)) as bigint) as failures from (
  select t.doc_id, len(list_filter(regexp_split_to_array(t.text, '\\s+'), lambda x: x <> '')) as n_words, s.n_scored
  from texts t left join (select doc_id, count(*) as n_scored from merged_words group by doc_id) s
  on t.doc_id = s.doc_id) x"""))
def q_alignment_check(spark, sf):
    texts, pieces = ad.subword_pieces(spark, sf)
    counts = explain.alignment_counts(explain.merge_subwords(pieces, texts), texts)
    return counts.agg(F.count_if(F.col("n_words") != F.col("n_scored")).alias("failures"))


# Shapley attribution of a model that is no sum of words: the square of the text's letters
SHAPLEY_SAMPLES, SHAPLEY_SEED = 4, 42


def _square_of_letters():
    def predict(texts):
        n = [float(sum(map(len, t.split()))) for t in texts]
        return [0.0] * len(n), [x * x / 100.0 for x in n]

    return predict


@query("shapley_words", "X2 M6", with_(["texts", "words"], f"""
select w.doc_id, cast(w.word_pos as integer) as pos, w.word as token, {r9('a.attr')} as attr, 0.0::double as base,
  {r9('f.n * f.n / 100.0::double')} as score
from words w join (select doc_id, sum(length(word))::double as n from words group by doc_id) f on w.doc_id = f.doc_id
join (select doc_id, word_pos, avg((2 * coalesce(pre, 0) * len + len * len) / 100.0::double) as attr from (
  select doc_id, word_pos, length(word) as len, sum(length(word)) over (partition by doc_id, s
    order by md5(concat_ws('|', '{SHAPLEY_SEED}', cast(doc_id as varchar), cast(s as varchar), cast(word_pos as varchar)))
    rows between unbounded preceding and 1 preceding) as pre
  from words, (select unnest(range({SHAPLEY_SAMPLES})) as s) r) m group by doc_id, word_pos) a
on w.doc_id = a.doc_id and w.word_pos = a.word_pos"""))
def q_shapley_words(spark, sf):
    texts = load(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))
    a = attribution.shapley(texts, "doc_id", "text", _square_of_letters, samples=SHAPLEY_SAMPLES, seed=SHAPLEY_SEED)
    return a.select("doc_id", "pos", "token", *[sr9(F.col(c)).alias(c) for c in ("attr", "base", "score")])


def _words_model():
    """A model that cannot read texts with an at sign."""
    def predict(texts):
        if any("@" in t for t in texts):
            raise ValueError("at sign")
        return [1.0] * len(texts), [len(t.split()) / 10.0 for t in texts]

    return predict


@query("user_model_scores", "M6 L5", f"""
select conv_id, turn, logit_0, logit_1, {r9('1.0::double / (1.0::double + exp(-logit_1))')} as prob, cast(logit_1 > logit_0 as integer) as pred,
  case when logit_1 is null then 'ValueError: at sign' end as error
from (select conv_id, turn, case when not contains(t, '@') then 1.0::double end as logit_0,
        case when not contains(t, '@') then len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) / 10.0::double end as logit_1
      from (select conv_id, turn, coalesce(text, '') as t from conversations) c) s""")
def q_user_model_scores(spark, sf):
    c = load(spark, sf, "conversations").select("conv_id", "turn", "text")
    s = models.score_with(c, _words_model, "text", ["conv_id", "turn"], on_error="skip")
    return s.select("conv_id", "turn", "logit_0", "logit_1", sr9(F.col("prob")).alias("prob"), "pred", "error")
