"""Column-level text functions.

All are built-in Spark expressions: they run inside whole-stage codegen and
need no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's ``[^\w\s]`` written so it also keeps accented
# letters under Java regex (whose \w is ASCII only).
PUNCT_RE = r"[^\p{L}\p{N}_\s]"
WS_RE = r"\s+"
# The ASCII punctuation set Python's string.punctuation holds.
ASCII_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize_blanks(col) -> Column:
    """Map the no-break space to a blank so Java \\s splits like Python's str.split."""
    return F.translate(_c(col), "\u00a0", " ")


def clean_lower(col) -> Column:
    """lower-case, then drop every char that is not a letter, digit, '_' or blank."""
    return F.regexp_replace(F.lower(_c(col)), PUNCT_RE, "")


def strip_punct(col) -> Column:
    """same as F1 but keeps the case (marks)."""
    return F.regexp_replace(_c(col), PUNCT_RE, "")


def tokens(col) -> Column:
    """Whitespace tokens without empties (Python ``str.split()``)."""
    return F.filter(F.split(_c(col), WS_RE), lambda t: t != F.lit(""))


def word_count(col) -> Column:
    """number of whitespace-separated words; 0 for an empty or blank text."""
    return F.size(tokens(col))


def indicator_text(col, prefix: str) -> Column:
    """``prefix`` followed by the value as text (null stays null)."""
    return F.concat(F.lit(prefix), _c(col).cast("string"))


def flag_text(col, yes: str, no: str) -> Column:
    """one of two literal texts for a 0/1 flag (anything but 1 is ``no``)."""
    return F.when(_c(col) == 1, F.lit(yes)).otherwise(F.lit(no))


def pseudo_mark_text(col) -> Column:
    """``Pseudo mark is <text>`` or the default literal for a missing one."""
    return F.coalesce(F.concat(F.lit("Pseudo mark is "), _c(col)), F.lit("no Pseudo mark"))


def strip_markers(col, markers=("[SEP]", "[CLS]")) -> Column:
    """remove model marker tokens from a text."""
    out = _c(col)
    for m in markers:
        out = F.replace(out, F.lit(m), F.lit(""))
    return out


def strip_ascii_punct(col) -> Column:
    """remove ASCII punctuation characters from a word."""
    return F.translate(_c(col), ASCII_PUNCT, "")


def has_token(col, word) -> Column:
    """whole-token containment of ``word`` in a whitespace-split text."""
    w = word if isinstance(word, Column) else F.lit(word)
    return F.array_contains(F.split(_c(col), " "), w)


def starts_with_trimmed(col, prefix: str) -> Column:
    """Null-safe ``strip().startswith(prefix)``: a null code is not a match."""
    return F.coalesce(F.startswith(F.trim(_c(col)), F.lit(prefix)), F.lit(False))


def norm_eq(a, b) -> Column:
    """``a.strip().lower() == b.strip().lower()``; a null on either side is unequal."""
    return F.coalesce(F.lower(F.trim(_c(a))) == F.lower(F.trim(_c(b))), F.lit(False))


def split_frame(df, n: int):
    """split the work into ``n`` parts (a repartition; the parts are
    processed in parallel by the executors, never looped over)."""
    return df.repartition(n)
