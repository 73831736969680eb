"""Global order without a single task (W2, P12, W12-W17, and the prefix sums
behind ROC/AUC).

A window without ``partitionBy`` moves every row to one task. Instead:

1. range-partitioned sort (``orderBy``), positions taken inside each sorted
   partition (``spark_partition_id`` + the low bits of
   ``monotonically_increasing_id``);
2. the sorted table is checkpointed to the shared checkpoint folder, so a
   lost executor recomputes from a fixed sorted copy instead of re-sampling
   new range bounds (which would renumber rows);
3. per-partition counts/sums form a table with one row per (group,
   partition); its prefix sums are the offsets, and it is joined back
   (broadcast only because its size is bounded by the partition count).

Hot groups are safe: the sort key ends in a unique row key, so the range
partitioner splits even a group holding a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markspark.operators.joins import local_broadcast

# (group, partition) rows above which the offset table is joined by shuffle
_OFFSETS_MAX = 200_000
from markspark.session import checkpoint_dir

_POS_MASK = (1 << 33) - 1


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def sorted_positions(df: DataFrame, order: list, partition_by: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Sort, tag each row with its partition and in-partition position, checkpoint (of the columns, those in ``keep`` if given)."""
    pb = list(partition_by or [])
    s = (df.orderBy(*_cols(pb), *_cols(order))
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POS_MASK))))
    checkpoint_dir(df.sparkSession)
    return (s if keep is None else s.select(*keep, "_pid", "_pos")).checkpoint(eager=True)


def _offsets(s: DataFrame, pb: list[str], values: dict[str, Column]) -> DataFrame:
    """One row per (group, partition): first position, count, value sums and
    their exclusive prefix sums over earlier partitions of the same group."""
    aggs = [F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_cnt")]
    aggs += [F.sum(v).alias(f"_s_{k}") for k, v in values.items()]
    small = s.groupBy(*pb, "_pid").agg(*aggs)
    before = Window.partitionBy(*pb).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*pb)
    small = small.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    small = small.withColumn("_n", F.sum("_cnt").over(whole))
    for k in values:
        small = small.withColumn(f"_o_{k}", F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)))
        small = small.withColumn(f"_t_{k}", F.sum(f"_s_{k}").over(whole))
    return small


def _bounded(small: DataFrame, pb: list[str]) -> DataFrame:
    """Broadcast the offset table: without groups it has one row per sorted
    partition (bounded by construction); with groups its size is checked."""
    return F.broadcast(small) if not pb else local_broadcast(small, _OFFSETS_MAX)


def _null_safe(s: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on equal or equally null keys, so a null group keeps its rows."""
    right = small.withColumnsRenamed({c: f"_k_{c}" for c in on})
    cond = None
    for c in on:
        eq = s[c].eqNullSafe(right[f"_k_{c}"])
        cond = eq if cond is None else cond & eq
    return s.join(right, cond).drop(*[f"_k_{c}" for c in on])


def global_index(df: DataFrame, order: list, partition_by: list[str] | None = None,
                 out: str = "idx", total: str | None = "n_total", keep: list[str] | None = None) -> DataFrame:
    """0-based position of each row in ``order`` (within ``partition_by`` groups).

    Adds ``out`` and, if ``total`` is set, the group's row count. ``keep`` names the columns to go on with (all; those of
    ``partition_by`` stay), so that columns only ordered by are not stored.
    """
    pb = list(partition_by or [])
    s = sorted_positions(df, order, pb, None if keep is None else [*pb, *[c for c in keep if c not in pb]])
    small = _offsets(s, pb, {}).select(*pb, "_pid", "_first", "_off", "_n")
    j = _null_safe(s, _bounded(small, pb), [*pb, "_pid"])
    j = j.withColumn(out, F.col("_off") + F.col("_pos") - F.col("_first"))
    if total:
        j = j.withColumn(total, F.col("_n"))
    return j.drop("_pid", "_pos", "_first", "_off", "_n")


def prefix_sums(df: DataFrame, order: list, values: dict[str, Column | str],
                partition_by: list[str] | None = None, inclusive: bool = True,
                with_totals: bool = True) -> DataFrame:
    """Running sums of ``values`` in ``order`` (within groups), adding
    ``cum_<name>`` (and ``tot_<name>`` with ``with_totals``).

    Inside a partition the running sum is a window over (group, partition),
    whose size is bounded by the range partition; across partitions the
    offsets come from the small per-partition table.
    """
    pb = list(partition_by or [])
    vals = {k: (F.col(v) if isinstance(v, str) else v) for k, v in values.items()}
    base = df
    for k, v in vals.items():
        base = base.withColumn(f"_v_{k}", v)
    s = sorted_positions(base, order, pb)
    small = _offsets(s, pb, {k: F.col(f"_v_{k}") for k in vals})
    keep = [*pb, "_pid"] + [f"_o_{k}" for k in vals] + ([f"_t_{k}" for k in vals] if with_totals else [])
    frame = (Window.partitionBy(*pb, "_pid").orderBy("_pos")
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    for k in vals:
        s = s.withColumn(f"_w_{k}", F.coalesce(F.sum(f"_v_{k}").over(frame), F.lit(0)))
    j = _null_safe(s, _bounded(small.select(*keep), pb), [*pb, "_pid"])
    for k in vals:
        j = j.withColumn(f"cum_{k}", F.col(f"_o_{k}") + F.col(f"_w_{k}"))
        if with_totals:
            j = j.withColumnRenamed(f"_t_{k}", f"tot_{k}")
    drop = ["_pid", "_pos"] + [f"_{p}_{k}" for k in vals for p in ("v", "o", "w")]
    return j.drop(*drop)


def ntile_of(idx, n, k: int) -> Column:
    """1-based tile of a 0-based index among ``n`` rows in ``k`` near-equal parts
    (the first ``n % k`` parts get one row more: ``ntile`` / ``array_split``)."""
    idx, n = _cols([idx, n])
    q = F.floor(n / F.lit(k)).cast("bigint")
    r = (n % F.lit(k)).cast("bigint")
    big = r * (q + 1)
    return (F.when(idx < big, F.floor(idx / (q + 1)) + 1)
            .otherwise(r + F.floor((idx - big) / F.greatest(q, F.lit(1))) + 1)).cast("int")


def decile_chart(scored: DataFrame, cuts: int = 10, prob: str = "prob", label: str = "label",
                 pred: str = "pred", key: list[str] | None = None) -> DataFrame:
    """Sort by probability (descending; ties by key), cut into ``cuts``
    near-equal parts, and report per part: n, n_0, n_1, pred_0, pred_1 and
    acc/prec/recall in % (2 places) and f1 (0 places). 0/0 gives NULL."""
    from markspark.functions.numeric import pct, round_even
    key = key or ["row_id"]
    slim = scored.select(*dict.fromkeys([prob, label, pred, *key]))
    ix = global_index(slim, [F.col(prob).desc(), *key])
    tiled = ix.withColumn("tile", ntile_of("idx", "n_total", cuts))
    lab, prd = F.col(label), F.col(pred)
    g = tiled.groupBy("tile").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(lab).cast("bigint").alias("n_1"),
        F.sum(prd).cast("bigint").alias("pred_1"),
        F.count_if((lab == 1) & (prd == 1)).alias("tp"),
        F.count_if((lab == 0) & (prd == 0)).alias("tn"),
        F.count_if((lab == 0) & (prd == 1)).alias("fp"),
        F.count_if((lab == 1) & (prd == 0)).alias("fn"))
    g = (g.withColumn("n_0", F.col("n") - F.col("n_1"))
          .withColumn("pred_0", F.col("n") - F.col("pred_1"))
          .withColumn("acc", pct(F.col("tp") + F.col("tn"), F.col("n")))
          .withColumn("prec", pct(F.col("tp"), F.col("tp") + F.col("fp")))
          .withColumn("recall", pct(F.col("tp"), F.col("tp") + F.col("fn"))))
    f1 = round_even(F.try_divide(F.lit(2.0) * F.col("prec") * F.col("recall"),
                                 F.col("prec") + F.col("recall")), 0)
    return g.withColumn("f1", f1).select("tile", "n", "n_0", "n_1", "pred_0", "pred_1",
                                         "acc", "prec", "recall", "f1")


def topk(df: DataFrame, by: list[str] | None, score: str, k: int = 10,
         key: list[str] | None = None, rank_col: str = "rank") -> DataFrame:
    """The ``k`` highest scores per group (ties broken by ``key``).

    Grouped: ``row_number`` over the group, which Spark plans with a
    per-partition group limit before the shuffle. Ungrouped: ordered limit
    (``TakeOrderedAndProject``: each task keeps k rows).
    """
    order = [F.col(score).desc(), *[F.col(c) for c in (key or [])]]
    if not by:
        return df.orderBy(*order).limit(k).withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def topk_share(attr: DataFrame, doc: str, word: str, score: str, k: int = 5) -> DataFrame:
    """The ``k`` top-scoring words of each document with their share (%)
    of the document's total score."""
    w = Window.partitionBy(doc)
    ranked = topk(attr.withColumn("_total", F.sum(score).over(w)), [doc], score, k, key=[word])
    return ranked.withColumn("share", F.try_divide(F.col(score) * F.lit(100.0), F.col("_total"))).drop("_total")


def doc_minmax(attr: DataFrame, doc: str, score: str, out: str = "scaled") -> DataFrame:
    """Min-max scale scores inside each document; constant scores give NULL."""
    w = Window.partitionBy(doc)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return attr.withColumn(out, F.try_divide(F.col(score) - lo, hi - lo))


def head(df: DataFrame, order: list, n: int) -> DataFrame:
    """First ``n`` rows in an explicit order."""
    return df.orderBy(*_cols(order)).limit(n)


def exact_quantiles(df: DataFrame, col: str, qs: list[float], by: list[str] | None = None,
                    out: str = "_q") -> DataFrame:
    """Linearly interpolated exact quantiles of ``col`` (per ``by`` group) as an array column ``out`` aligned with ``qs``,
    by bracketing (:func:`markspark.operators.selection.bracketed_quantiles`): the input is never sorted, and no task holds
    all values of a group."""
    from markspark.operators.selection import bracketed_quantiles
    return bracketed_quantiles(df, col, qs, by, out)
