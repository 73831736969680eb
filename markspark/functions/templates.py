"""Model-input text assembly.

The segments are joined with ``concat`` on purpose: like ``+`` on text
columns, a null segment makes the whole input null (``concat_ws`` would skip
it and silently produce a shorter input).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markspark.functions.numeric import md5_unit

# Begin and separator markers of the two marker styles.
MARKERS = {
    "cls": ("[CLS] ", " [SEP] "),
    "s_tag": ("<s> ", " </s> "),
}

# Segment order of the full input, processed and unprocessed.
FULL_SEGMENTS = {
    "processed": ["mark_processed", "statement_processed", "mark_translated", "wordnet_text",
                  "mark_length_text", "nice_cat_text", "nice_description_preprocessed",
                  "pseudo_mark_processed"],
    "unprocessed": ["mark_unprocessed", "statement_unprocessed", "mark_translated", "wordnet_text",
                    "mark_length_text", "nice_cat_text", "nice_description_unpreprocessed",
                    "pseudo_mark_unprocessed"],
}


def segments(variant: str, processed: bool = True) -> list[str]:
    """Column names of one input variant in their fixed order."""
    full = FULL_SEGMENTS["processed" if processed else "unprocessed"]
    if variant in ("full", "shuffled"):
        return list(full)
    if variant == "only_mark":
        return full[:1]
    if variant == "wo_mark":
        return full[1:]
    if variant == "short":
        return ["mark", "description", "nice_class_text"]
    raise ValueError(f"unknown model-input variant {variant!r}")


def join_segments(cols: list[Column], style: str = "cls") -> Column:
    begin, sep = MARKERS[style]
    parts: list[Column] = [F.lit(begin)]
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(c)
    return F.concat(*parts)


def model_input(variant: str = "full", style: str = "cls", processed: bool = True,
                seed: int = 42, key: str | None = None) -> Column:
    """The model's input text for one row.

    ``shuffled`` orders the segments per row by md5(seed, key, position), a
    deterministic and engine-portable stand-in for an unseeded shuffle.
    """
    names = segments(variant, processed)
    if variant != "shuffled":
        return join_segments([F.col(n) for n in names], style)
    if key is None:
        raise ValueError("shuffled input needs a row key")
    begin, sep = MARKERS[style]
    tagged = F.array(*[F.struct(md5_unit(F.lit(seed), F.col(key), F.lit(i)).alias("h"),
                                F.col(n).alias("s")) for i, n in enumerate(names)])
    ordered = F.transform(F.array_sort(tagged), lambda x: x["s"])
    has_null = F.exists(ordered, lambda x: x.isNull())
    return F.when(~has_null, F.concat(F.lit(begin), F.array_join(ordered, sep)))
