"""The corpus pipeline: documents to token ids, each stage's result stored and read again by the next.

ORACLE_SQL is None: SQL can express neither the importance resampling of the
first stage nor the BPE encoding of the last; tests/llm compares the stages
with brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from markspark.llm import stages
from markspark.llm.common import stored, table

STAGES = [
    ("quality_classifier", stages.quality_classifier),
    ("line_dedup", stages.line_dedup_stage),
    ("near_dedup", stages.near_dedup),
    ("decontamination", stages.decontamination),
    ("bpe_encoding", stages.bpe_encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
