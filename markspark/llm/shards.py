"""Operator 5: shards by jump consistent hashing, in DataFrame functions only.

A row's key is hashed to 64 bits (its text form, so any key type works) and
walked through the jump sequence b0 < b1 < b2 ... of its linear congruential
generator; with n shards the row belongs to the last b below n. There is no
ring table: key and shard count decide alone, and with n + 1 shards a row
either stays or moves to the new shard n, on average one row in n + 1.

Slots (0, 1, 2, ... without gaps inside a shard) come from counts, not from a
sort of a whole shard: a row falls into one of ``salts`` cells of its shard by
a hash of its content, rows are numbered inside the cell, and the cells'
offsets are running sums over a table of at most shards x salts rows. Equal
rows are counted before the shuffle and numbered as one run, so a key or text
that fills a third of the table is one row there.

Defined results: a null key is hashed as a key of its own; a null text has 0
bytes and the checksum of no bytes; repeated rows get slots of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Multiplier of the 64-bit generator in the published jump hash, in two halves (fixed values).
_A_HIGH, _A_LOW = divmod(2862933555777941757, 1 << 32)
_MASK = (1 << 32) - 1
#: Steps walked at once; a row that needs more (less than one in 10^40 for a million shards) walks on.
_STEPS = 96


def jump_pair(key: Column, n: int) -> Column:
    """struct(shard, grown): the key's shard among n and among n + 1 shards."""
    if n < 1:
        raise ValueError("at least one shard")
    code = F.xxhash64(F.coalesce(key.cast("string"), F.lit("\0null")))
    start = F.struct(F.shiftrightunsigned(code, 32).alias("h"), code.bitwiseAND(F.lit(_MASK)).alias("l"),
                     F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("small"), F.lit(0).cast("long").alias("j"))
    most = n + 1

    def walk(state: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, lambda s, _: _step(s, most))

    first = walk(start, min(most, _STEPS))
    if most > _STEPS:
        first = F.when(first["j"] >= most, first).otherwise(walk(first, most))
    return F.struct(first["small"].cast("int").alias("shard"), first["b"].cast("int").alias("grown"))


def _step(s: Column, n: int) -> Column:
    """One round of the generator (key = key * A + 1 mod 2^64) on 16- and 32-bit pieces, so no product
    leaves 63 bits. State: h, l the halves of the key; j the next shard; b the last below n, small below n - 1."""
    def low16(x):
        return x.bitwiseAND(F.lit(65535).cast("long"))

    def times32(x, a):
        return (low16(x) * F.lit(a) + F.shiftleft(low16(F.shiftright(x, 16) * F.lit(a)), 16)).bitwiseAND(F.lit(_MASK))

    h, l, b, small, j = (s[k] for k in ("h", "l", "b", "small", "j"))  # noqa: E741
    p1 = F.shiftright(l, 16) * F.lit(_A_LOW)
    low = low16(l) * F.lit(_A_LOW) + F.shiftleft(low16(p1), 16) + 1
    carry = F.shiftright(p1, 16) + F.shiftright(low, 32)
    new_h = (carry + times32(h, _A_LOW) + times32(l, _A_HIGH)).bitwiseAND(F.lit(_MASK))
    new_j = F.floor((j + 1) * (F.lit(2147483648.0) / (F.shiftright(new_h, 1) + 1)))
    return F.when(j >= n, s).otherwise(F.struct(
        new_h.alias("h"), low.bitwiseAND(F.lit(_MASK)).alias("l"), j.alias("b"),
        F.when(j < n - 1, j).otherwise(small).alias("small"), new_j.alias("j")))


def shard_rows(df: DataFrame, key: str, text: str, n_shards: int = 40, extra_bytes: int = 16, salts: int = 1024) -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) for every row of ``df``.

    ``size`` is the text's UTF-8 bytes plus ``extra_bytes``. ``salts`` cells a
    shard bound a window's group: at 30 billion rows and 40 shards one holds
    under a million. The offset table (n_shards x salts rows at most) is broadcast.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = (df.select(F.col(key).alias("k"), (F.octet_length(body).cast("long") + extra_bytes).alias("size"),
                      F.crc32(body.cast("binary")).alias("crc"))
            .groupBy("k", "size", "crc").agg(F.count(F.lit(1)).alias("n")))
    placed = (rows.withColumn("p", jump_pair(F.col("k"), n_shards))
              .select("k", "size", "crc", "n", F.col("p.shard").alias("shard"), F.col("p.grown").alias("grown"),
                      F.pmod(F.xxhash64("k", "crc", "size"), F.lit(salts)).cast("int").alias("cell")))
    cells = (placed.groupBy("shard", "cell").agg(F.sum("n").alias("in_cell"))
             .withColumn("offset", F.sum("in_cell").over(W.partitionBy("shard").orderBy("cell")) - F.col("in_cell"))
             .select("shard", "cell", "offset"))
    inside = W.partitionBy("shard", "cell").orderBy("k", "crc", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = placed.withColumn("to", F.sum("n").over(inside))
    return (numbered.join(F.broadcast(cells), ["shard", "cell"])
            .select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "shard",
                    F.explode(F.sequence(F.col("offset") + F.col("to") - F.col("n"), F.col("offset") + F.col("to") - 1)).alias("slot"),
                    F.col("grown").alias("grown_shard")))
