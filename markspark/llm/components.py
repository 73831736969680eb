"""Connected components of a link table, by local contraction and star steps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markspark.llm.common import giving_back, stored

#: Links one task contracts at a time (two ids and a map entry each).
_LOCAL = 200_000


class Forest:
    """Union-find over hashable, ordered ids; the root is the smallest id."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up, top = self.up, x
        while up.get(top, top) != top:
            top = up[top]
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        lo, hi = (a, b) if a < b else (b, a)
        self.up[hi] = lo
        self.up.setdefault(lo, lo)
        return True

    def links(self):
        return [(x, self.root(x)) for x in self.up if self.root(x) != x]


def contract(batches, kind: pa.DataType):
    """Links (a, b) of a task's batches to star links (node, smallest node of its part)."""
    def out(f):
        links = f.links()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], kind), pa.array([y for _, y in links], kind)],
                                          names=["u", "v"])

    forest, n = Forest(), 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        n += batch.num_rows
        if n >= _LOCAL:
            yield out(forest)
            forest, n = Forest(), 0
    yield out(forest)


def components(links: DataFrame, kind: str = "binary") -> DataFrame:
    """(u, root) for every node of ``links(a, b)`` that is not itself its component's smallest node.

    Each round lets every node point its larger neighbours, then its smaller
    ones, at the smallest node it knows (large and small star). A node with a
    great many links is handled by aggregation and an equi-join, never in one
    group. Rounds go on until the link table stays the same.
    """
    arrow = pa.binary() if kind == "binary" else pa.int64()
    edges = stored(links.select("a", "b").mapInArrow(giving_back(lambda it: contract(it, arrow)), f"u {kind}, v {kind}").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        edges = stored(small, "links")
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                          F.coalesce(F.max(F.expr("cast(1 as int)")), F.lit(0))).first()
        # a forest of stars maps to itself
        if after == before or not after[0]:
            return edges.select("u", F.col("v").alias("root"))
        before = after
