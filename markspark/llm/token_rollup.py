"""Operator 8: token totals by source, language and tokenizer version, kept up to date by deltas.

Every change to a document is a signed row: +1 document and +n tokens for an
insert, -1 and -n for a delete, both for a revised count or a move to another
tokenizer version. A batch of changes is summed per key and written below a new
attempt; then one commit row names the attempt as the state of its batch id.
Totals are the sum over each batch's last committed attempt, so a retried or
replayed batch changes nothing, a batch corrected to no rows counts nothing,
and an attempt that failed half-way is never read. Attempts are ordered by the
committing driver's clock: commits of one batch come from one driver at a time.

Defined results: before the first commit there are no totals; null source or language is a key of its own; a null text has
0 tokens; keys whose documents are all gone are left out of the totals;
changes to a document that was never inserted make a negative total, which
shows. Equal rows count each.
"""

from __future__ import annotations

import base64
import time
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markspark.llm.bpe import Codec, _codec

KEYS = ["source", "lang", "version"]
_DELTA = "source string, lang string, version string, docs long, tokens long"
_COMMIT = "batch long, attempt string"
#: One document in so many is deleted and inserted again.
WAVE = 7


class Rollup:
    """Token totals in one folder, which all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        commits = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
        self.committed = commits.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(commits)

    def commit(self, batch: int, changes: DataFrame) -> None:
        """Add ``changes(source, lang, version, docs, tokens)``, signed, as batch number ``batch``; again is harmless."""
        delta = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        attempt = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        delta.coalesce(8).write.parquet(f"{self.path}/attempts/attempt={attempt}")
        # the step that makes the attempt the batch's state: one file, put in place by the writer's own commit
        self.spark.createDataFrame([(batch, attempt)], _COMMIT).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        self.committed = True

    def deltas(self) -> DataFrame:
        """(source, lang, version, docs, tokens, batch): the last committed attempt of every batch."""
        if not self.committed:
            return self.spark.createDataFrame([], f"{_DELTA}, batch long")
        last = self.spark.read.schema(_COMMIT).parquet(f"{self.path}/commits").groupBy("batch").agg(F.max("attempt").alias("attempt"))
        rows = self.spark.read.schema(f"{_DELTA}, attempt string").parquet(f"{self.path}/attempts")
        return rows.join(last, "attempt").drop("attempt")

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens) after all committed batches."""
        return (self.deltas().groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
                .filter((F.col("docs") != 0) | (F.col("tokens") != 0)))


def signed(counts: DataFrame, version: str, tokens: str, sign: int) -> DataFrame:
    """Changes that insert (sign 1) or delete (sign -1) the rows of ``counts(source, lang, <tokens>)``."""
    return counts.select("source", "lang", F.lit(version).alias("version"), F.lit(sign).cast("long").alias("docs"),
                         (F.col(tokens) * sign).cast("long").alias("tokens"))


@lru_cache(maxsize=2)
def _ranks(path: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(path: str, texts: list[str]) -> list[int]:
    if path.endswith(".tiktoken"):
        return [len(_ranks(path).encode_ordinary(t)) for t in texts]
    codec: Codec = _codec(path)
    return [codec.count(t) for t in texts]


def token_counts(docs: DataFrame, first: str, second: str, recounted: list[str] | None = None) -> DataFrame:
    """(doc_id, th, source, lang, n_first, n_second): tokens of whole texts with the vocabulary file ``first``, and
    with ``second`` of all of them, or where the language is among ``recounted`` (else null)."""
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [t or "" for t in part.column(4).to_pylist()]
                again = [recounted is None or lang in recounted for lang in part.column(3).to_pylist()]
                other = iter(_count(second, [t for t, x in zip(texts, again, strict=True) if x]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], pa.array(_count(first, texts), pa.int64()),
                     pa.array([next(other) if x else None for x in again], pa.int64())],
                    names=["doc_id", "th", "source", "lang", "n_first", "n_second"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"),
                      F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    return src.mapInArrow(run, "doc_id long, th long, source string, lang string, n_first long, n_second long")


def maintain(rollup: Rollup, counts: DataFrame, first: str, second: str) -> None:
    """The corpus' history as three batches: insert every document; delete later copies of a text;
    revise the documents that have a count of the second version. The second batch comes twice."""
    rollup.commit(1, signed(counts, first, "n_first", 1))
    # the first document of each text stays (smallest id, nulls last); repeated rows of it stay too
    first_of = counts.groupBy("th").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("f")).select("th", "f.doc_id")
    keep = first_of.withColumnRenamed("doc_id", "kept")
    marked = counts.join(keep, "th").withColumn("copy", ~F.col("doc_id").eqNullSafe(F.col("kept")))
    gone = signed(marked.filter("copy"), first, "n_first", -1)
    rollup.commit(2, gone)
    revised = marked.filter("not copy and n_second is not null")
    rollup.commit(3, signed(revised, first, "n_first", -1).unionByName(signed(revised, second, "n_second", 1)))
    rollup.commit(2, gone)


def maintain_all(rollup: Rollup, counts: DataFrame, first: str, second: str) -> None:
    """The whole corpus under both versions, as four batches: insert every document; delete a wave of them; insert the
    wave again; add the second version of every document. The second batch comes twice. The batches net to the table."""
    wave = counts.filter(F.pmod(F.xxhash64("doc_id", "th"), F.lit(WAVE)) == 0)
    rollup.commit(1, signed(counts, first, "n_first", 1))
    rollup.commit(2, signed(wave, first, "n_first", -1))
    rollup.commit(3, signed(wave, first, "n_first", 1))
    rollup.commit(4, signed(counts, second, "n_second", 1))
    rollup.commit(2, signed(wave, first, "n_first", -1))
