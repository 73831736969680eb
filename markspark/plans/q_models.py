"""Feature, model and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from markspark.functions.numeric import md5_unit
from markspark.functions.text import flag_text, indicator_text, strip_punct, word_count
from markspark.operators import ablation
from markspark.operators import evaluate as ev
from markspark.operators import explain, features, joins, models, stats
from markspark.plans import adapters as ad
from markspark.plans.oracle import CLASS_CHAIN, CTE, with_
from markspark.plans.q_cases import class_table
from markspark.plans.registry import query
from markspark.plans.sqlkit import r9, sr9
from markspark.session import materialize
from markspark.sources.tables import load

# The language codes of the document table (one-hot columns).
LANGS = ["de", "en", "es", "fr"]
N_DIMS = 64
SEED = 42


@query("one_hot", "F17", with_(CLASS_CHAIN, """
select serial_no, cast(intl_class_cd = 9 as integer) as nice_class_9, cast(intl_class_cd = 16 as integer) as nice_class_16,
  cast(intl_class_cd = 25 as integer) as nice_class_25 from class_int"""))
def q_one_hot(spark, sf):
    return features.one_hot(class_table(spark, sf), "intl_class_cd", "nice_class_")


CTE["wv"] = """
select token, list_transform(embedding, lambda x: x::double / size) as vector
from (select l.token, e.embedding, sqrt(list_sum(list_transform(e.embedding, lambda x: x::double * x::double))) as size
  from lexicon l join embeddings e
  on e.vec_id = (('0x' || substr(md5(l.token), 1, 8))::bigint % (select count(*) from embeddings))) u where size > 0"""
CTE["doc_tokens"] = """
select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) as token from documents"""
CTE["doc_vec"] = """
select k.doc_id, cast(k.dim as integer) as dim, coalesce(avg(x.v), 0.0) as value
from (select doc_id, unnest(range(0, (select max(len(vector)) from wv))) as dim from documents) k left join (
  select t.doc_id, unnest(range(0, len(w.vector))) as dim, unnest(w.vector) as v
  from doc_tokens t join wv w on t.token = w.token) x on x.doc_id = k.doc_id and x.dim = k.dim group by k.doc_id, k.dim"""
VEC = ["lexicon", "wv", "doc_tokens", "doc_vec"]


def doc_vectors(spark, sf, labelled=False):
    d = load(spark, sf, "documents").select("doc_id", "text")
    if labelled:
        d = joins.semi(d, load(spark, sf, "labels").select("doc_id"), "doc_id")
    return features.sentence_vectors(d, "doc_id", "text", ad.word_vectors(spark, sf))


@query("sentence_vectors", "M1 F19", with_(VEC, f"select doc_id, dim, {r9('value')} as value from doc_vec"))
def q_sentence_vectors(spark, sf):
    lv = features.long_vectors(doc_vectors(spark, sf), "doc_id", "vector")
    return lv.select("doc_id", "dim", sr9(F.col("value")).alias("value"))


def conv_texts(spark, sf):
    st = ad.statements(spark, sf)
    a = stats.concat_text(st.filter(F.col("statement_type_cd") == "user"), "serial_no", "statement_text", "seq", out="a")
    b = stats.concat_text(st.filter(F.col("statement_type_cd") == "assistant"), "serial_no", "statement_text", "seq", out="b")
    return a.join(b, "serial_no")


CTE["conv_ab"] = """
select a.conv_id, a.t as a, b.t as b from
  (select conv_id, string_agg(text, ' ' order by turn) as t from conversations where role = 'user' group by conv_id) a
  join (select conv_id, string_agg(text, ' ' order by turn) as t from conversations where role = 'assistant'
        group by conv_id) b on a.conv_id = b.conv_id"""


def _vec_sql(col):
    return f"""
select k.conv_id, cast(k.dim as integer) as dim, coalesce(avg(x.v), 0.0) as value
from (select conv_id, unnest(range(0, (select max(len(vector)) from wv))) as dim from conv_ab) k left join (
  select t.conv_id, unnest(range(0, len(w.vector))) as dim, unnest(w.vector) as v
  from (select conv_id, unnest(list_filter(regexp_split_to_array(lower({col}), '\\s+'), lambda x: x <> '')) as token
        from conv_ab) t join wv w on t.token = w.token) x on x.conv_id = k.conv_id and x.dim = k.dim group by k.conv_id, k.dim"""


@query("vector_diff", "M2 F18", with_(["lexicon", "wv", "conv_ab"], f"""
select a.conv_id as serial_no, a.dim, {r9('a.value - b.value')} as value
from ({_vec_sql('a')}) a join ({_vec_sql('b')}) b on a.conv_id = b.conv_id and a.dim = b.dim"""))
def q_vector_diff(spark, sf):
    d = features.vector_diff(conv_texts(spark, sf), "serial_no", "a", "b", ad.word_vectors(spark, sf))
    lv = features.long_vectors(d, "serial_no", "v")
    return lv.select("serial_no", "dim", sr9(F.col("value")).alias("value"))


def doc_labelled(spark, sf):
    """Labelled documents (J7 inner join to labels) with their word count."""
    d = load(spark, sf, "documents").select("doc_id", "text", "lang")
    lab = load(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return d.join(lab, "doc_id").withColumn("n_words", word_count(strip_punct("text")))


def doc_base(spark, sf):
    """Labelled documents with length and lexicon flag."""
    return joins.lexicon_indicator(doc_labelled(spark, sf), "doc_id", "text", ad.lexicon(spark, sf))


def feature_rows(spark, sf):
    base = doc_base(spark, sf).select("doc_id", "label", "n_words", "wn_ind", "lang")
    # the table has labelled documents only (J7): no other document's vector is made
    return features.feature_table(base, "doc_id", doc_vectors(spark, sf, labelled=True), "vector", N_DIMS,
                                  class_col="lang", class_prefix="lang_", class_values=LANGS)


_FT_DIMS = ", ".join(f"{r9(f'max(case when v.dim = {i} then v.value end)')} as emb_dim_{i}" for i in range(N_DIMS))
_FT_LANG = ", ".join(f"cast(d.lang = '{x}' as integer) as lang_{x}" for x in LANGS)


@query("feature_table", "M3 J7 F17 F19", with_(VEC, f"""
select d.doc_id, l.quality as label,
  cast(len(list_filter(regexp_split_to_array(regexp_replace(d.text, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+'),
       lambda x: x <> '')) as integer) as n_words,
  case when exists (select 1 from doc_tokens t where t.doc_id = d.doc_id and t.token in (select token from lexicon))
    then 1 else 0 end as wn_ind,
  {_FT_LANG}, {_FT_DIMS}
from documents d join labels l on d.doc_id = l.doc_id join doc_vec v on d.doc_id = v.doc_id
group by d.doc_id, l.quality, d.text, d.lang"""))
def q_feature_table(spark, sf):
    f = feature_rows(spark, sf)
    dims = [f"emb_dim_{i}" for i in range(N_DIMS)]
    return f.select(*[c for c in f.columns if c not in dims], *[sr9(F.col(c)).alias(c) for c in dims])


def _split(df, key):
    test = (md5_unit(F.lit(SEED), F.col(key)) % 5) == 0
    return df.filter(~test), df.filter(test)


GBT_ITER, GBT_DEPTH = 20, 5  # registered query sizes; the operator defaults are 500 / 7
TEXT_FEATURES, TEXT_ITER = 1 << 18, 100  # the operator defaults


def _gbt(spark, sf):
    f = features.assemble(feature_rows(spark, sf), ["doc_id", "label"])
    names = [c for c in f.columns if c not in ("doc_id", "label", "features")]
    f = materialize(f.select("doc_id", "label", "features"))  # the vector holds the single columns
    train, test = _split(f, "doc_id")
    m = models.train_gbt(train, "features", "label", max_iter=GBT_ITER, max_depth=GBT_DEPTH)
    return m, test, names


@query("gbt_scores", "M4 M6 M3")
def q_gbt_scores(spark, sf):
    m, test, _ = _gbt(spark, sf)
    return models.score(m, test, keep=["doc_id", "label"])


@query("split_importance", "M7")
def q_split_importance(spark, sf):
    m, _, names = _gbt(spark, sf)
    return models.split_importance(m, names, 10)


def _text_model(spark, sf, text_col="text"):
    d = materialize(doc_labelled(spark, sf))
    train, test = _split(d, "doc_id")
    m = models.train_text_classifier(train, text_col, "label", reg=0.01, max_iter=TEXT_ITER, num_features=TEXT_FEATURES)
    return m, d, test


@query("text_classifier_scores", "M5 M6")
def q_text_classifier_scores(spark, sf):
    m, _, test = _text_model(spark, sf)
    return models.score(m, test, keep=["doc_id", "label"])


def ablation_input() -> tuple[list, dict]:
    """The input's segments and the variants compared: all segments, the text alone, all but the text, an order per row."""
    segments = [F.col("text"), F.col("lang"), indicator_text("n_words", "word count is "),
                flag_text("wn_ind", "word in lexicon", "no word in lexicon")]
    return segments, {"full": ablation.fixed_order(0, 1, 2, 3), "text_only": ablation.fixed_order(0),
                      "wo_text": ablation.fixed_order(1, 2, 3), "shuffled": ablation.shuffled_order("doc_id", 4, SEED)}


def ablation_scores(spark, sf):
    """Test documents scored by the classifier of every variant."""
    segments, variants = ablation_input()
    test = (md5_unit(F.lit(SEED), F.col("doc_id")) % 5) == 0
    rows = ablation.variant_rows(doc_base(spark, sf), "doc_id", "label", segments, variants, TEXT_FEATURES, test)
    fit = ablation.fit_together(rows, list(variants), TEXT_FEATURES)
    return ablation.score_variants(rows.filter("test"), fit, "doc_id")


@query("ablation_report", "E18 F7 M5 E2 E5")
def q_ablation_report(spark, sf):
    s = materialize(ablation_scores(spark, sf))
    return ev.accuracy(s, by=["variant"]).join(ev.auc(s, by=["variant"]), "variant")


@query("ablation_classes", "E18 E3")
def q_ablation_classes(spark, sf):
    return ev.classification_report(ablation_scores(spark, sf), by=["variant"])


@query("occlusion", "X2")
def q_occlusion(spark, sf):
    m, d, _ = _text_model(spark, sf)
    return explain.occlusion_linear(m, d.select("doc_id", "text"), "doc_id", "text")
