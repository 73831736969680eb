"""Word attribution.

Sub-word scores are merged into whole words by aligning character offsets:
the running count of non-blank characters of the pieces is matched against
the running length of the text's words in one ordered pass per document
(windows partitioned by document; no pairs of pieces and words are formed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markspark.functions.numeric import sigmoid
from markspark.functions.text import strip_punct, tokens
from markspark.operators.order import topk


def merge_subwords(pieces: DataFrame, texts: DataFrame, doc: str = "doc_id", pos: str = "pos",
                   piece: str = "piece", score: str = "score", text: str = "text") -> DataFrame:
    """Mean piece score per whitespace word of the text.

    A piece equal to one blank is skipped. A piece belongs to the first word
    not yet complete when it arrives (so a leading empty piece counts in the
    first word; pieces after the last word are dropped).
    Output: (doc, word_pos, word, score, n_pieces).
    """
    p = pieces.filter(F.col(piece) != F.lit(" ")).select(
        doc, pos, score, F.length(F.regexp_replace(piece, r"\s", "")).alias("_nb"))
    before = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("_off", F.coalesce(F.sum("_nb").over(before), F.lit(0)))
    w = texts.select(doc, F.posexplode(tokens(F.col(text))).alias("word_pos", "word"))
    upto = Window.partitionBy(doc).orderBy("word_pos").rowsBetween(Window.unboundedPreceding, 0)
    w = w.withColumn("_end", F.sum(F.length("word")).over(upto))
    ev = (w.select(doc, F.col("_end").alias("_off"), F.lit(0).alias("_kind"), F.col("word_pos").alias("_ord"),
                   F.lit(None).cast("double").alias("_score"))
          .unionByName(p.select(doc, "_off", F.lit(1).alias("_kind"), F.col(pos).cast("bigint").alias("_ord"),
                                F.col(score).cast("double").alias("_score"))))
    run = Window.partitionBy(doc).orderBy("_off", "_kind", "_ord").rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.withColumn("_widx", F.sum(1 - F.col("_kind")).over(run))
    g = ev.filter(F.col("_kind") == 1).groupBy(doc, F.col("_widx").alias("word_pos")).agg(
        F.avg("_score").alias("score"), F.count(F.lit(1)).alias("n_pieces"))
    return w.select(doc, "word_pos", "word").join(g, [doc, "word_pos"])


def alignment_counts(merged: DataFrame, texts: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Q5 input: words per text and scored words per text."""
    n_words = texts.select(doc, F.size(tokens(F.col(text))).alias("n_words"))
    n_scored = merged.groupBy(doc).agg(F.count(F.lit(1)).alias("n_scored"))
    return n_words.join(n_scored, doc, "left").fillna(0, ["n_scored"])


def occlusion_linear(model, df: DataFrame, key: str, text: str) -> DataFrame:
    """X2 for the hashed-TF-IDF logistic pipeline: change of the logit and of
    the probability when one token occurrence is left out.

    For this linear model, leaving out token t lowers the logit by exactly
    ``coef[h(t)] * idf[h(t)]``, which is the logit of a one-token text minus
    the intercept. Those contributions are computed by the model itself on
    the distinct tokens, then joined back: linear in the text length, where
    re-scoring every leave-one-out text would be quadratic. (A different
    estimator from SHAP; see README.)
    """
    from pyspark.ml.functions import vector_to_array
    toks = df.select(key, F.posexplode(tokens(F.lower(F.col(text)))).alias("pos", "token"))
    vocab = toks.select("token").distinct().withColumn(text, F.col("token"))
    raw1 = vector_to_array(F.col("rawPrediction"))[1]
    intercept = float(model.stages[-1].intercept)
    contrib = model.transform(vocab).select("token", (raw1 - F.lit(intercept)).alias("delta_logit"))
    full = model.transform(df.select(key, text)).select(key, raw1.alias("_m"))
    j = toks.join(contrib, "token").join(full, key)
    return j.select(key, "pos", "token", "delta_logit",
                    (sigmoid(F.col("_m")) - sigmoid(F.col("_m") - F.col("delta_logit"))).alias("delta_prob"))


def word_weights(attr: DataFrame, sign: int = 1, score: str = "attr", out: str = "weight") -> DataFrame:
    """Signed weights for display; only positive weights are kept."""
    return attr.withColumn(out, F.lit(float(sign)) * F.col(score)).filter(F.col(out) > 0)


def topk_with_marks(attr: DataFrame, marks: DataFrame, by: str, word: str, score: str, k: int,
                    mark_key: str, mark_text: str) -> DataFrame:
    """The top ``k`` words per group with every mark of the same group
    that contains the word as a whole token (long form, one row per mark).

    Marks are split at any white space. A top word that no mark holds is looked
    up once more without its punctuation (``word`` stays as it is); if there is no mark then
    either, it has one row with a null ``mark_key``."""
    top = topk(attr, [by], score, k, key=[word])
    top = top.select(by, word, score, "rank", strip_punct(F.col(word)).alias("_plain"))
    wanted = top.select(by, F.explode(F.array_distinct(F.array(word, "_plain"))).alias("_token")).distinct()
    held = marks.select(by, mark_key, F.explode(F.array_distinct(tokens(F.col(mark_text)))).alias("_token")).distinct()
    held = held.join(wanted, [by, "_token"], "left_semi")  # k words a group: few tokens of the marks go on
    whole = top.join(held.select(by, F.col("_token").alias(word), F.col(mark_key)), [by, word], "left")
    none = whole.filter(F.col(mark_key).isNull()).drop(mark_key)
    again = none.join(held.select(by, F.col("_token").alias("_plain"), F.col(mark_key)), [by, "_plain"], "left")
    cols = [by, word, score, "rank", mark_key]
    return whole.filter(F.col(mark_key).isNotNull()).select(*cols).unionByName(again.select(*cols))
