"""Attribution for any scorer (X2): Shapley values of a text's words by permutation sampling.

Each sample puts the words of a text in a seeded random order and scores the text
with none, one, two, ... and at last all of them in place. What the score gains
when a word comes in is the word's share in that sample; its attribution is the
mean over the samples, so a sample's shares telescope to the score of the whole
text less that of the empty one.

The masked texts are made in the stage that scores them (long form, one row per
sample and step, never shuffled), and the scorer is the user's own model behind
:func:`markspark.operators.models.score_with`. A scored row adds its score to the
word that came in last and takes it from the next one, so the shares need no
ordering: one aggregation with map-side sums.

A text of more than ``players`` words is attributed by runs of words: its words
form that many runs of near-equal length, a run comes in as one, and its share
is spread evenly over its words. Work is samples x players texts a row at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markspark.functions.text import tokens
from markspark.operators.models import score_with
from markspark.session import materialize

#: Stand for the empty and the whole text among the players' sums.
_EMPTY, _WHOLE = -1, -2


def masked_texts(df: DataFrame, key: str, text: str, samples: int, seed: int, players: int, mask: str | None) -> DataFrame:
    """(key, _before, _after, _step, _players, _masked): the text of every sample and step, the player that came in last and
    the one that comes next. Order: md5 of seed|key|sample|player."""
    rows = df.select(F.col(key), tokens(F.col(text)).alias("_toks")).filter(F.size("_toks") > 0)
    n = F.size("_toks")
    rows = rows.withColumn("_players", F.least(n, F.lit(players)))
    rows = rows.withColumn("_sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    place = lambda p: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col("_sample").cast("string"),
                                                 p.cast("string"))).alias("h"), p.alias("p"))
    order = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.col("_players") - 1), place)), lambda x: x["p"])
    rows = rows.withColumn("_order", order)
    ranks = F.transform(F.array_sort(F.transform("_order", lambda p, r: F.struct(p.alias("p"), r.alias("r")))), lambda x: x["r"])
    rows = rows.withColumn("_ranks", ranks).withColumn("_step", F.explode(F.sequence(F.lit(0), F.col("_players"))))
    player = lambda i: F.floor(i.cast("long") * F.col("_players") / n).cast("int")
    shown = F.transform("_toks", lambda t, i: F.when(F.get(F.col("_ranks"), player(i)) < F.col("_step"), t).otherwise(F.lit(mask)))
    return rows.select(key, F.get(F.col("_order"), F.col("_step") - 1).alias("_before"), F.get(F.col("_order"), F.col("_step")).alias("_after"),
                       "_step", "_players", F.array_join(shown, " ").alias("_masked"))


def shapley(df: DataFrame, key: str, text: str, load_model: Callable[[], Callable], samples: int = 16, seed: int = 42,
            players: int = 256, mask: str | None = None, value: str = "logit_1", on_error: str = "raise") -> DataFrame:
    """(key, pos, token, attr, base, score): each word's attribution to ``value`` (a column of score_with's result).

    ``load_model`` as in :func:`score_with`; a masked word is left out, or replaced by ``mask``. ``attr`` of a row's words
    add up to score - base, the values of the whole and of the masked text: what rounding, or a failed text
    (``on_error='skip'``), leaves over is spread evenly. ``key`` names a row; a null or wordless text gives no row.
    For a scorer that adds up words the result is exact with any number of samples."""
    slim = df.select(key, text)
    masked = masked_texts(slim, key, text, samples, seed, players, mask)
    scored = score_with(masked, load_model, "_masked", [key, "_before", "_after", "_step", "_players"], on_error=on_error)
    v = F.col(value).cast("double")
    parts = F.array(F.struct(F.col("_before").alias("p"), v.alias("v")), F.struct(F.col("_after").alias("p"), (-v).alias("v")),
                    F.struct(F.when(F.col("_step") == 0, _EMPTY).alias("p"), v.alias("v")),
                    F.struct(F.when(F.col("_step") == F.col("_players"), _WHOLE).alias("p"), v.alias("v")))
    sums = scored.select(key, "_players", F.explode(F.filter(parts, lambda x: x["p"].isNotNull())).alias("_x"))
    sums = sums.groupBy(key, "_players", F.col("_x.p").alias("_player")).agg(F.sum("_x.v").alias("_sum"), F.avg("_x.v").alias("_avg"))
    sums = materialize(sums)  # one row per row and player: scored once, read for the shares and for their rest
    end = lambda p: F.max(F.when(F.col("_player") == p, F.col("_avg")))
    shared = F.sum(F.when(F.col("_player") >= 0, F.col("_sum"))) / F.lit(float(samples))
    rows = sums.groupBy(key).agg(end(_EMPTY).alias("base"), end(_WHOLE).alias("score"), shared.alias("_shared"))
    n = F.size("_toks")
    words = slim.select(key, tokens(F.col(text)).alias("_toks")).filter(F.size("_toks") > 0)
    words = words.select(key, F.least(n, F.lit(players)).alias("_count"), n.alias("_n"), F.posexplode("_toks").alias("pos", "token"))
    words = words.withColumn("_player", F.floor(F.col("pos").cast("long") * F.col("_count") / F.col("_n")).cast("int"))
    # words of a run: positions p with floor(p * count / n) = player
    size = F.ceil((F.col("_player") + 1) * F.col("_n") / F.col("_count")) - F.ceil(F.col("_player") * F.col("_n") / F.col("_count"))
    rest = (F.col("score") - F.col("base") - F.col("_shared")) / F.col("_count")
    share = F.coalesce(F.col("_sum"), F.lit(0.0)) / F.lit(float(samples)) + rest
    found = words.join(sums.filter("_player >= 0").select(key, "_player", "_sum"), [key, "_player"], "left").join(rows, key)
    return found.select(key, "pos", "token", (share / size).alias("attr"), "base", "score")
