"""Operator 13: how a chain of document filters interact.

Every document fails some of k filters: a mask of k bits. Documents are
counted by part and mask (for five filters at most 32 cells a part), and only
the cells go on. One walk over the 2^k sets of active filters in Gray-code
order toggles one filter at a time. Each cell keeps the number of active
filters that it fails; when that counter leaves or reaches 0, the cell's
documents leave or join the running survivors. The survivors of every set are
kept (32 states), and every figure of every order of the filters is a
difference of states: what a step removes is the state before less the state
after it, what a filter alone removes the full set's state without and with it.

A filter that compares documents (:func:`repeats`) is decided on ids and text
checksums: the smallest id of each text is found by a partial aggregate, and
rows meet it again by (checksum, id), so that a group of copies is never in
one task. Repeated rows are counted before any join.

Defined results: a null text is empty; a null part is the empty string; a row
with a null id repeats nothing, is never the first of its text and has no
label; rows that repeat an id count one by one; of several labels of an id
the highest of each kind counts; an empty table has no part and no row.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspark.llm.common import stored

#: Orders are listed one by one (k! of them).
MAX_FILTERS = 6
_ROW = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
        "good_lost long, toxic_lost long, shapley long")


def text_failures(text: Column) -> dict[str, Column]:
    """The filters on a document's own text (A short, B repetitive, C upper case, D symbols): true where it fails."""
    words = F.array_remove(F.split(text, r"[ \t-\r]+"), "")
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": F.size(words) < 200,
            "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
            "C": 100 * upper > 2 * F.length(text),
            "D": text.rlike("[#$%&*|]")}


def repeats(rows: DataFrame) -> DataFrame:
    """``rows(__id, __th, ...)`` with __repeat: a smaller id has the same text."""
    first = rows.filter("__id is not null").groupBy("__th").agg(F.min("__id").alias("__first"))
    first = first.select(F.col("__th").alias("__th1"), "__first")
    found = rows.join(first, (F.col("__th") == F.col("__th1")) & (F.col("__id") == F.col("__first")), "left")
    return found.withColumn("__repeat", F.col("__id").isNotNull() & F.col("__first").isNull()).drop("__th1", "__first")


def cells(docs: DataFrame, labels: DataFrame, failures: dict[str, Column], same_text: str | None = "E") -> DataFrame:
    """(part, mask, n, good, toxic): ``docs(doc_id, source, text)`` counted by the filters that they fail, bit i for
    the i-th of ``failures`` and then ``same_text`` (None: no such filter). ``failures`` read the column __text."""
    slim = docs.select(F.col("doc_id").alias("__id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       F.coalesce("text", F.lit("")).alias("__text"))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures.values())), F.lit(0))
    rows = slim.select("__id", "part", F.unhex(F.sha2("__text", 256)).alias("__th"), mask.alias("mask"))
    rows = rows.groupBy("__id", "part", "__th", "mask").agg(F.count(F.lit(1)).alias("n"))
    if same_text:
        rows = repeats(stored(rows, "audit")).withColumn(
            "mask", F.col("mask") + F.when(F.col("__repeat"), 1 << len(failures)).otherwise(0))
    rows = rows.groupBy("__id", "part", "mask").agg(F.sum("n").alias("n"))
    marks = labels.groupBy(F.col("doc_id").alias("__label_id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("__good"), F.max((F.col("toxic") == 1).cast("long")).alias("__toxic"))
    found = rows.join(marks, F.col("__id") == F.col("__label_id"), "left")
    return found.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("__good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("__toxic", F.lit(0))).alias("toxic"))


def states(masks: list[int], counts: np.ndarray, k: int) -> np.ndarray:
    """Survivors (n, good, toxic) under each of the 2^k sets of active filters, by a Gray-code walk over the cells."""
    out = np.zeros((1 << k, counts.shape[1]), np.int64)
    alive, failed, on = counts.sum(0), [0] * len(masks), 0
    out[0] = alive
    for step in range(1, 1 << k):
        bit = step & -step  # the one filter that this step toggles
        on ^= bit
        turn = 1 if on & bit else -1
        for i, mask in enumerate(masks):
            if mask & bit:
                failed[i] += turn
                if failed[i] == (turn > 0):  # its first active failure came, or its last one went
                    alive = alive - turn * counts[i]
        out[on] = alive
    return out


def report(kept: np.ndarray, names: list[str]):
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order's steps."""
    k, full = len(names), (1 << len(names)) - 1
    fails = [int(kept[0, 0] - kept[1 << i, 0]) for i in range(k)]
    unique = [int(kept[full ^ 1 << i, 0] - kept[full, 0]) for i in range(k)]
    shapley = [sum(factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()) * int(kept[s, 0] - kept[s | 1 << i, 0])
                   for s in range(1 << k) if not s >> i & 1) for i in range(k)]
    for order in permutations(range(k)):
        on, name = 0, "".join(names[i] for i in order)
        for step, i in enumerate(order, 1):
            gone = kept[on] - kept[on | 1 << i]
            on |= 1 << i
            yield (name, step, int(kept[on, 0]), int(gone[0]), fails[i] - int(gone[0]), unique[i], int(gone[1]), int(gone[2]),
                   shapley[i])


def audit(docs: DataFrame, labels: DataFrame, failures: dict[str, Column], same_text: str | None = "E") -> DataFrame:
    """One row per part, order of the filters and step, from :func:`cells`."""
    names = [*failures, *([same_text] if same_text else [])]
    if len(names) > MAX_FILTERS:
        raise ValueError(f"{len(names)} filters have too many orders; {MAX_FILTERS} at most")
    parts = cells(docs, labels, failures, same_text).groupBy("part").agg(
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2^k at most

    def walk(batches):
        for batch in batches:
            for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.array([(c["n"], c["good"], c["toxic"]) for c in found], np.int64)
                rows = list(report(states([c["mask"] for c in found], counts, len(names)), names))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(rows)), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()),
                     *(pa.array([r[j] for r in rows], pa.int64()) for j in range(2, 9))],
                    names=[c.split(" ")[0] for c in _ROW.split(", ")])

    return parts.mapInArrow(walk, _ROW)
