"""Joins and set operations.

Equi-joins only. Broadcasts are never assumed from optimizer estimates
(an exploded text column, for one, is estimated far below its real size):
:func:`maybe_broadcast` measures a bounded row count of the side first, and
a side that is not provably small goes through a shuffle join (AQE may still
turn that into a broadcast at run time from real, measured sizes).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markspark.functions.text import tokens


# The detachment rules of English nouns, verbs and adjectives (suffix, ending).
ENGLISH_FORMS = [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"),
                 ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", ""),
                 ("er", ""), ("est", ""), ("er", "e"), ("est", "e")]

# Byte budget for a side broadcast behind a measured row count.
BROADCAST_BUDGET = 32 << 20


def bounded_rows(df: DataFrame, max_rows: int) -> int | None:
    """Row count of ``df`` if it is at most ``max_rows``, else None.

    Measured, not estimated: a limited count stops reading once the bound
    is passed, so checking a big side costs at most ``max_rows`` rows per task.
    """
    n = df.limit(max_rows + 1).count()
    return n if n <= max_rows else None


def maybe_broadcast(df: DataFrame, row_bytes: int = 256, budget: int = BROADCAST_BUDGET) -> DataFrame:
    """Broadcast hint only behind a proven size bound.

    The side is broadcast when its measured row count times ``row_bytes``
    fits the budget; otherwise it is joined by shuffle, and AQE may still turn
    the join into a broadcast from the real size of the shuffled side.
    """
    max_rows = max(budget // max(row_bytes, 1), 1)
    return F.broadcast(df) if bounded_rows(df, max_rows) is not None else df


def local_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """A small table (at most ``max_rows`` rows, checked) collected once and
    broadcast as a local relation; None-equivalent fallback is the table itself."""
    rows = df.take(max_rows + 1)
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def anti(df: DataFrame, other: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``other``."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(other.select(*keys), on=keys, how="left_anti")


def semi(df: DataFrame, other: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``other`` (no duplicates added)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(other.select(*keys), on=keys, how="left_semi")


def key_intersect(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys present in both tables."""
    return a.select(key).intersect(b.select(key))


def join_all(dfs: list[DataFrame], key: str | list[str], how: str = "inner") -> DataFrame:
    """Fold a list of tables into one join on the same key."""
    keys = [key] if isinstance(key, str) else list(key)
    return reduce(lambda l, r: l.join(r, on=keys, how=how), dfs)


def left_lookup(df: DataFrame, dim: DataFrame, key: str | list[str], check: bool = False,
                broadcast: str = "runtime") -> DataFrame:
    """Left join that must keep the row count.

    The dimension key must be unique; ``check=True`` verifies it with one
    aggregate (Q2) before the join and raises otherwise. ``broadcast``:
    ``"bounded"`` when the dimension's size is bounded by construction (a
    code table), ``"measure"`` to measure it first, ``"runtime"`` to leave the
    choice to AQE's measured shuffle sizes.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if check:
        from markspark.operators.checks import expect_unique
        expect_unique(dim, keys, raise_on_fail=True)
    if broadcast == "bounded":
        dim = F.broadcast(dim)
    elif broadcast == "measure":
        dim = maybe_broadcast(dim, row_bytes=512)
    return df.join(dim, on=keys, how="left")


def word_forms(token, rules: list[tuple[str, str]]):
    """The base forms ``token`` may stand for: itself, and for each rule (suffix, ending) whose suffix it ends with,
    the token with the ending in its place; a token that is the suffix alone has no such form."""
    t = F.col(token) if isinstance(token, str) else token
    each = [F.when(F.endswith(t, F.lit(suffix)) & (F.length(t) > len(suffix)),
                   F.concat(F.substring(t, F.lit(1), F.length(t) - len(suffix)), F.lit(ending))) for suffix, ending in rules]
    return F.array_distinct(F.array_compact(F.array(t, *each)))


def lexicon_indicator(df: DataFrame, key: str, text: str, lexicon: DataFrame,
                      token_col: str = "token", out: str = "wn_ind", lower: bool = True,
                      rules: list[tuple[str, str]] | None = None, exceptions: DataFrame | None = None) -> DataFrame:
    """1 when any whitespace token of ``text`` is in ``lexicon``, else 0.

    Tokens are exploded and semi-joined to the lexicon (a hash join, the
    lexicon broadcast only when its size is checked), reduced to distinct
    matching keys, then left-joined back: no per-row Python, no nested loop.

    With ``rules`` a token also hits by a base form of :func:`word_forms`, made in the same explode (at most one
    row more a rule that fits). ``exceptions(form, lemma)`` are irregular forms: those of a lemma in the lexicon join
    the lexicon, so the texts are still read once. A null form, lemma or lexicon token hits nothing.
    """
    t = tokens(F.lower(F.col(text)) if lower else F.col(text))
    if rules:
        t = F.flatten(F.transform(t, lambda x: word_forms(x, rules)))
    exploded = df.select(key, F.explode(t).alias(token_col))
    lex = lexicon.select(token_col).distinct()
    if exceptions is not None:
        irregular = exceptions.join(lex, exceptions["lemma"] == lex[token_col], "left_semi").select(F.col("form").alias(token_col))
        lex = lex.unionByName(irregular).distinct()
    hits = exploded.join(maybe_broadcast(lex, row_bytes=64), on=token_col, how="left_semi").select(key).distinct()
    flagged = hits.withColumn(out, F.lit(1))
    return df.join(flagged, on=key, how="left").withColumn(out, F.coalesce(F.col(out), F.lit(0)))


def apply_translation(df: DataFrame, translations: DataFrame, keys: list[str],
                      mark: str = "mark_processed", translated: str = "mark_translated",
                      out: str = "mark_final", sentinel: str = "-1") -> DataFrame:
    """Inner join to a translation table; the sentinel keeps the processed mark."""
    j = df.join(translations.select(*keys, translated), on=keys, how="inner")
    return j.withColumn(out, F.when(F.col(translated) == F.lit(sentinel), F.col(mark))
                        .otherwise(F.col(translated)))


def union_all(dfs: list[DataFrame]) -> DataFrame:
    """Union by column name."""
    return reduce(lambda a, b: a.unionByName(b), dfs)
