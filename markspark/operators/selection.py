"""Selection by rank without sorting the input.

Quantiles: a mergeable quantile sketch per group gives, for each wanted rank,
two values with the rank surely between them; one filtered pass then counts the
values below and inside each bracket, and only the distinct values inside the
brackets (some thousandths of the rows) are put in order. A value held by a third
of the rows is one row of that table.

Samples: the n rows with the smallest hashes of each group are found by radix
selection: counts by hash prefix name the prefix that holds the n-th hash, that
prefix alone is counted by longer prefixes, and so on until few rows are left.
Their n-th row is the group's cut, and one filter keeps the rows up to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markspark.operators.order import _bounded, _null_safe, prefix_sums
from markspark.session import materialize

#: Ranks of the sketch are right to 1 / ACCURACY of a group's rows; a smaller group is ordered as it is.
ACCURACY = 2_000
#: Hex digits by which a prefix grows, and rows of a prefix that are ordered directly.
_DIGITS, _FEW = 3, 10_000
_MD5 = 32


def _brackets(base: DataFrame, by: list[str], qs: list[float], sketch: bool) -> DataFrame:
    """(by, _n, _b): each group's rows and for each quantile a value below and one above it (null: no bound)."""
    if not sketch:
        none = F.lit(None).cast("double")
        ends = [F.struct(F.lit(i).alias("i"), none.alias("a"), none.alias("b")) for i in range(len(qs))]
        return base.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.array(*ends))
    margin = 3.0 / ACCURACY
    wanted = [min(max(q + d, 0.0), 1.0) for q in qs for d in (-margin, margin)]
    found = base.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", wanted, ACCURACY).alias("_p"))
    large = F.col("_n") >= ACCURACY
    ends = [F.struct(F.lit(i).alias("i"), F.when(large, F.col("_p")[2 * i]).alias("a"), F.when(large, F.col("_p")[2 * i + 1]).alias("b"))
            for i in range(len(qs))]
    return found.select(*by, "_n", F.array(*ends).alias("_b"))


def _inside(base: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    """(by, _n, _i, _v, _c): how often each value inside bracket i occurs, and under _v null how many values are below it."""
    rows = _null_safe(base, _bounded(brackets, by), by)
    rows = rows.select(*by, "_n", "_v", F.explode(F.filter("_b", lambda b: b["b"].isNull() | (F.col("_v") <= b["b"]))).alias("_x"))
    value = F.when(F.col("_x.a").isNull() | (F.col("_v") >= F.col("_x.a")), F.col("_v"))
    return rows.groupBy(*by, "_n", F.col("_x.i").alias("_i"), value.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))


def bracketed_quantiles(df: DataFrame, col: str, qs: list[float], by: list[str] | None = None, out: str = "_q") -> DataFrame:
    """Linearly interpolated exact quantiles of ``col`` (per ``by`` group) as an array column ``out`` aligned with ``qs``.

    Null values count nowhere, a null group is a group, NaN is the largest value. Without groups there is one row, of
    nulls if there is no value."""
    keys = list(by or []) or ["_one"]
    base = df.select(*(by or [F.lit(0).alias("_one")]), F.col(col).cast("double").alias("_v")).filter("_v is not null")
    at = F.element_at(F.array(*[F.lit(float(q)) for q in qs]), F.col("_i") + 1) * (F.col("_n") - 1)
    picked = None
    for sketch in (True, False):
        counts = _inside(base, _brackets(base, keys, qs, sketch), keys)
        run = prefix_sums(counts, ["_v"], {"c": "_c"}, [*keys, "_i"], with_totals=False)  # nulls, the rows below, come first
        run = run.withColumn("_lo", F.floor(at)).withColumn("_hi", F.ceil(at)).withColumn("_before", F.col("cum_c") - F.col("_c"))
        here = lambda p: F.max(F.when((F.col("_before") <= F.col(p)) & (F.col(p) < F.col("cum_c")), F.col("_v")))
        picked = materialize(run.groupBy(*keys, "_i").agg(F.first("_n").alias("_n"), here("_lo").alias("_lo_v"), here("_hi").alias("_hi_v")))
        if not picked.filter("_lo_v is null or _hi_v is null").limit(1).count():
            break  # every rank lies in its bracket; otherwise all values are ordered
    part = at - F.floor(at)
    value = F.when(part == 0, F.col("_lo_v")).otherwise(F.col("_lo_v") + part * (F.col("_hi_v") - F.col("_lo_v")))
    picked = picked.withColumn("_value", value)
    return picked.groupBy(*(by or [])).agg(F.array(*[F.max(F.when(F.col("_i") == i, F.col("_value"))) for i in range(len(qs))]).alias(out))


def _cut_prefixes(rows: DataFrame, by: list[str], n: int) -> DataFrame | None:
    """(by, _p, _need): the hash prefix in which each group's n-th row lies and its place there; groups of n rows or fewer
    have none. None if no group has more."""
    width, cut = 0, None
    while True:
        width = min(width + _DIGITS, _MD5)
        if cut is None:
            part = rows.withColumn("_need", F.lit(n).cast("long"))
        else:
            part = in_prefix(rows, cut, by, width - _DIGITS)
        bins = part.groupBy(*by, "_need", F.substring("_h", 1, width).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
        # at most 16^3 prefixes of a group
        run = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("_cum", F.sum("_c").over(run)).withColumn("_all", F.sum("_c").over(Window.partitionBy(*by)))
        enough = F.col("_all") > F.col("_need") if cut is None else F.lit(True)
        here = (F.col("_cum") - F.col("_c") < F.col("_need")) & (F.col("_need") <= F.col("_cum"))
        cut = materialize(bins.filter(enough & here).select(*by, "_p", (F.col("_need") - F.col("_cum") + F.col("_c")).alias("_need"), "_c"))
        most = cut.agg(F.max("_c")).first()[0]
        if most is None:
            return None
        if most <= _FEW or width == _MD5:
            return cut.drop("_c")


def in_prefix(rows: DataFrame, cut: DataFrame, by: list[str], width: int | None = None) -> DataFrame:
    """The ``rows`` in their group's cut prefix, with ``_need``."""
    found = _null_safe(rows, _bounded(cut.select(*by, "_p", "_need"), by or ["_p"]), by)
    size = F.length("_p") if width is None else F.lit(width)
    return found.filter(F.substring(F.col("_h"), F.lit(1), size) == F.col("_p")).drop("_p")


def first_by_hash(df: DataFrame, by: list[str], n: int, h: Column, ties: list[str]) -> DataFrame:
    """The ``n`` rows of each ``by`` group (null is a group) that come first by the md5 text ``h``, ``ties`` and, last, a
    hash of the whole row; of rows that are equal in all columns as many as fit. Groups of ``n`` rows or fewer stay whole.

    Rows that share one hash (one key repeated) are ordered in one window; all others are only counted."""
    if n < 1:
        return df.limit(0)
    group = list(by) or ["_one"]
    names = [f"_t{i}" for i in range(len(ties))]
    whole = F.xxhash64(*[F.col(c) for c in df.columns])
    tagged = df if by else df.withColumn("_one", F.lit(0))
    slim = tagged.select(*group, h.alias("_h"), *[F.col(t).alias(x) for t, x in zip(ties, names, strict=True)], whole.alias("_x"))
    cut = _cut_prefixes(slim.select(*group, "_h"), group, n)
    if cut is None:
        return df
    order = ["_h", *names, "_x"]
    rows = in_prefix(slim, cut, group)
    w = Window.partitionBy(*group).orderBy(*order)
    same = F.count(F.lit(1)).over(Window.partitionBy(*group, *order))
    last = rows.select(*group, "_need", F.struct(*order).alias("_cut"), F.row_number().over(w).alias("_at"),
                       F.rank().over(w).alias("_rank"), same.alias("_same"))
    last = materialize(last.filter("_at = _need").select(*group, "_cut", (F.col("_need") - F.col("_rank") + 1).alias("_left"), "_same"))
    place = F.struct(h.alias("_h"), *[F.col(t).alias(x) for t, x in zip(ties, names, strict=True)], whole.alias("_x"))
    right = _bounded(last.select(*group, "_cut", "_left").withColumnsRenamed({g: f"_k_{g}" for g in group}), group)
    cond = None
    for g in group:
        eq = tagged[g].eqNullSafe(right[f"_k_{g}"])
        cond = eq if cond is None else cond & eq
    found = tagged.join(right, cond, "left").withColumn("_place", place)
    kept = found.filter(F.col("_cut").isNull() | (F.col("_place") <= F.col("_cut")))
    if last.filter("_same > _left").limit(1).count():  # equal rows stand on both sides of a cut
        at_cut = F.col("_cut").isNotNull() & (F.col("_place") == F.col("_cut"))
        again = kept.filter(at_cut).select(*df.columns, "_left").dropDuplicates().withColumn(
            "_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_left"))))
        return kept.filter(~at_cut).select(*df.columns).unionByName(again.select(*df.columns))
    return kept.select(*df.columns)
