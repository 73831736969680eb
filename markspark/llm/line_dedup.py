"""Operator 2: cross-site line dedup by distinct-site spread.

Every line (blanks at its ends cut off) has a 128-bit hash. One aggregation
gives each hash a HyperLogLog sketch of the sites it occurs on; the tasks'
sketches merge, so a line's occurrences never meet. A sketch estimate clearly
over or under ``min_sites`` decides; lines within ``band`` of it get an exact
distinct count. Lines on at least ``min_sites`` sites are boilerplate and are
removed from every document but the first that holds them (smallest doc_id),
so no text is lost from the corpus.

A document's own lines stay in it, the occurrences of a boilerplate line (a
third of all documents may hold it) are salted and joined with copies of the
line's one row, and only positions are gathered, one list for each document.

Defined results: a null text stays null and has no lines; blank lines are
neither counted nor removed; a null site is no site, but its documents lose
boilerplate like the others; rows repeated with one id and text are treated
alike; null ids come last in the order of documents. Other lines and their
order stay as they are.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markspark.llm.common import giving_back

#: Sketch size (2^10 registers, about 3.3 % standard error) and four standard errors as the exact band.
LG_K, BAND = 10, 0.13
#: Occurrences of one line are joined in so many places, each with its copy of the line's one row.
SALTS = 32


def _lines(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, th, *more, pos, h1, h2) of every line that isn't blank."""
    rows = docs.select("doc_id", "th", *more, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    rows = rows.withColumn("line", F.trim("line")).filter("line <> ''")
    return rows.select("doc_id", "th", *more, "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _salted(lines: DataFrame) -> DataFrame:
    return lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "th", "pos"), F.lit(SALTS)).cast("int"))


def _copies(per_line: DataFrame) -> DataFrame:
    return per_line.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def boilerplate(docs: DataFrame, min_sites: int, band: float = BAND) -> DataFrame:
    """(h1, h2, none, first_id, first_th): lines on at least ``min_sites`` sites and the first document of each."""
    lines = _lines(docs, "site")
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"))
    spread = spread.filter(F.col("sites") >= int(min_sites * (1 - band)))
    near = spread.filter(F.col("sites") <= int(min_sites * (1 + band)) + 1)
    exact = (_salted(lines).join(_copies(near.select("h1", "h2")), ["h1", "h2", "salt"], "left_semi").groupBy("h1", "h2", "site").agg(F.lit(1).alias("x"))
             .groupBy("h1", "h2").agg(F.count("site").alias("exact")))
    found = (spread.join(exact, ["h1", "h2"], "left")
             .filter(F.coalesce("exact", "sites") >= min_sites))
    return found.select("h1", "h2", "first.none", F.col("first.doc_id").alias("first_id"), F.col("first.th").alias("first_th"))


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = 10) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``, plus __lines and __removed (line counts)."""
    own = docs.withColumn("__th", F.xxhash64("text"))
    slim = own.select(F.col("doc_id").alias("doc_id"), F.col("__th").alias("th"), F.col(site).cast("string").alias("site"), "text")
    bad = boilerplate(slim, min_sites)
    hits = _salted(_lines(slim)).join(_copies(bad), ["h1", "h2", "salt"]).filter(
        ~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("th") == F.col("first_th"))))
    lists = hits.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("__at")).select(
        F.col("doc_id").alias("__d"), F.col("th").alias("__h"), "__at")
    joined = own.join(lists, own["doc_id"].eqNullSafe(lists["__d"]) & (own["__th"] == lists["__h"]), "left").drop("__d", "__h", "__th")
    names = docs.columns
    text_at, at_at = names.index("text"), len(names)

    def rebuild(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts, n, gone = [], [], []
                for text, at in zip(part.column(text_at).to_pylist(), part.column(at_at).to_pylist(), strict=True):
                    lines = [] if text is None else text.split("\n")
                    n.append(sum(1 for x in lines if x.strip(" ")))
                    gone.append(len(at or ()))
                    if at:
                        drop = set(at)
                        text = "\n".join([x for i, x in enumerate(lines) if i not in drop])
                    texts.append(text)
                cols = list(part.columns[:at_at])
                cols[text_at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(gone, pa.int64())],
                                                 names=[*names, "__lines", "__removed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", `__lines` long, `__removed` long"
    return joined.mapInArrow(giving_back(rebuild), schema)
