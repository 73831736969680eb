"""The pipeline's stages: each takes and returns documents (the last: documents' ids with their tokens).

Defined results, of all stages: a null text is handled as its operator says (quality: weight 0; lines: none, stays null;
near-duplicates and decontamination: no words, stays; encoding: as empty); rows that repeat are judged alike, and of a
group of near-duplicates, repeated rows included, one row stays; a null id is an id of its own; an empty table
gives an empty one; columns besides those of ``documents`` pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markspark.llm import bpe, decontaminate, line_dedup, near_dup, quality
from markspark.llm.common import ship_code, table
from markspark.llm.queries import MIN_SITES, vocabulary


#: The columns of ``documents``; no helper column of a stage has a name like those that the others get.
_OWN = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _any_columns(stage: Stage) -> Stage:
    """The stage with the other columns renamed while it works, so that none clashes with its helper columns."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        plain = docs.toDF(*[c if c in _OWN else f"other_column_{i}" for i, c in enumerate(names)])
        return stage(spark, plain, sf_dir).toDF(*names)

    return run


@_any_columns
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling; the others go."""
    ship_code(spark)
    out = quality.select_quality(docs, table(spark, sf_dir, "labels"))
    return out.filter("__selected").select(*docs.columns)


@_any_columns
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines leave every document but the first; n_chars follows."""
    ship_code(spark)
    out = line_dedup.dedup_lines(docs, "source", MIN_SITES).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long"))


@_any_columns
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates (five-word shingles, similarity 0.8) stays."""
    ship_code(spark)
    return near_dup.keep_one(docs, k=5, percent=80)


@_any_columns
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten words in a row of a benchmark item (shorter items of five words or more: all of it) go."""
    ship_code(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10, min_words=5)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining document and the checksum of the text that they decode to."""
    ship_code(spark)
    out = bpe.encode(docs, vocabulary())
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
