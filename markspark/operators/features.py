"""Features (F17, F19, M1-M3).

Sentence vectors are built relationally: tokens are exploded and hash-joined
to the word-vector table (the join AQE can split for hot tokens), then
averaged per text by one aggregate with a column per dimension (partial
aggregation; no per-text list is ever collected).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspark.functions.numeric import md5_unit, vec_columns, vec_sub
from markspark.functions.text import tokens
from markspark.operators.joins import maybe_broadcast

#: Most columns that one_hot makes of its own accord.
MAX_CODES = 1000
#: Characters of a token cut into n-grams at once.
NGRAM_PIECE = 1024


def one_hot(df: DataFrame, col: str, prefix: str, values: list | None = None, drop: bool = True) -> DataFrame:
    """``<prefix><value>`` 0/1 columns for each value of ``col``.

    ``values`` defaults to the sorted distinct values, read back to name the
    columns; more than ``MAX_CODES`` of them raise, as such a column holds no codes.
    """
    if values is None:
        found = df.select(col).filter(F.col(col).isNotNull()).distinct().limit(MAX_CODES + 1).collect()
        if len(found) > MAX_CODES:
            raise ValueError(f"{col} has more than {MAX_CODES} distinct values; name the values to keep")
        values = sorted(r[0] for r in found)
    out = df.select("*", *[(F.col(col) == F.lit(v)).cast("int").alias(f"{prefix}{v}") for v in values])
    return out.drop(col) if drop else out


def sentence_vectors(df: DataFrame, key: str, text: str, word_vectors: DataFrame,
                     token_col: str = "token", vec_col: str = "vector", out: str = "vector") -> DataFrame:
    """M1: mean of the word vectors of each text's lower-case whitespace tokens, each scaled to length one first.

    Tokens without a vector, or with one of length zero, are skipped; a text with none (or null) gets the
    zero vector, so every row of ``df`` has one. The
    mean is one hash aggregate with a column per dimension (codegen, partial
    aggregation per task), so no per-text list is collected and no row is
    exploded per dimension.
    """
    dims = word_vectors.select(F.max(F.size(vec_col))).first()[0] or 0
    t = df.select(key, F.explode(tokens(F.lower(F.col(text)))).alias(token_col))
    size = F.sqrt(F.aggregate(vec_col, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    wv = word_vectors.select(token_col, vec_col, size.alias("_size")).filter("_size > 0").select(
        token_col, *[(F.col(vec_col)[i].cast("double") / F.col("_size")).alias(f"_d{i}") for i in range(dims)])
    j = t.join(maybe_broadcast(wv, row_bytes=64 + 8 * dims), token_col)
    g = j.groupBy(key).agg(*[F.avg(f"_d{i}").alias(f"_d{i}") for i in range(dims)])
    return df.select(key).join(g, key, "left").select(
        key, F.array(*[F.coalesce(f"_d{i}", F.lit(0.0)) for i in range(dims)]).alias(out))


def char_ngrams(token, lengths: tuple[int, int] = (3, 6)) -> tuple[Column, Column]:
    """(pieces, grams): the character n-grams of ``<token>`` are those that the function ``grams`` makes of each of ``pieces``.

    A piece has ``NGRAM_PIECE`` characters and as many of the next as a gram beginning in it needs, so a very long token
    is never one long list of grams.
    """
    low, high = lengths
    parts = F.regexp_extract_all(F.concat(F.lit("<"), token, F.lit(">")), F.lit(f"(?s).{{1,{NGRAM_PIECE}}}"), F.lit(0))
    pieces = F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.substring(F.get(parts, i + 1), 1, high - 1), F.lit(""))))

    def grams(piece):
        def of(n):
            last = F.least(F.lit(NGRAM_PIECE), F.length(piece) - n + 1)
            return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(piece, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
        return F.concat(*[of(n) for n in range(low, high + 1)])

    return pieces, grams


def with_unknown(df: DataFrame, text: str, word_vectors: DataFrame, ngram_vectors: DataFrame, buckets: int,
                 lengths: tuple[int, int] = (3, 6)) -> DataFrame:
    """M1: ``word_vectors(token, vector)`` and a vector for each other token of ``df``'s texts.

    An unknown token's vector is the mean of the vectors of the n-grams of ``<token>``, each occurrence counted;
    ``ngram_vectors(bucket, vector)`` has them by md5 of the gram modulo ``buckets``. Grams without a vector are
    left out, and a token with none stays unknown. Work on n-grams grows with the distinct unknown tokens, not the
    texts; a null or empty text has no token; without ``buckets`` nothing is added.
    """
    known = word_vectors.select("token", F.col("vector").cast("array<double>").alias("vector"))
    dims = ngram_vectors.select(F.max(F.size("vector"))).first()[0] or 0
    if buckets < 1 or dims < 1:
        return known
    new = df.select(F.explode(tokens(F.lower(F.col(text)))).alias("token")).distinct().join(known.select("token"), "token", "left_anti")
    pieces, grams = char_ngrams(F.col("token"), lengths)
    bucket = (md5_unit(F.col("gram")) % F.lit(buckets)).alias("bucket")
    hashed = (new.select("token", F.explode(pieces).alias("piece")).select("token", F.explode(grams(F.col("piece"))).alias("gram"))
              .select("token", bucket).groupBy("token", "bucket").agg(F.count(F.lit(1)).alias("times")))
    vectors = ngram_vectors.select("bucket", *[F.col("vector")[i].cast("double").alias(f"_d{i}") for i in range(dims)])
    joined = hashed.join(maybe_broadcast(vectors, row_bytes=64 + 8 * dims), "bucket")
    made = joined.groupBy("token").agg(*[(F.sum(F.col(f"_d{i}") * F.col("times")) / F.sum("times")).alias(f"_d{i}") for i in range(dims)])
    return known.unionByName(made.select("token", F.array(*[f"_d{i}" for i in range(dims)]).alias("vector")))


def vector_diff(df: DataFrame, key: str, a: str, b: str, word_vectors: DataFrame, out: str = "v") -> DataFrame:
    """M2: sentence vector of text ``a`` minus that of text ``b``."""
    va = sentence_vectors(df, key, a, word_vectors, out="_va")
    vb = sentence_vectors(df, key, b, word_vectors, out="_vb")
    return va.join(vb, key).select(key, vec_sub("_va", "_vb").alias(out))


def long_vectors(df: DataFrame, key: str, col: str) -> DataFrame:
    """Vector column as rows (key, dim, value)."""
    return df.select(key, F.posexplode(col).alias("dim", "value"))


def wide_vectors(df: DataFrame, col: str, n: int, prefix: str = "emb_dim_") -> DataFrame:
    """vector column as ``n`` named columns."""
    keep = [F.col(c) for c in df.columns if c != col]
    return df.select(*keep, *vec_columns(col, n, prefix))


def feature_table(base: DataFrame, key: str, vectors: DataFrame, vec_col: str, n_dims: int,
                  class_col: str | None = None, class_prefix: str = "nice_class_",
                  class_values: list | None = None) -> DataFrame:
    """M3: base features + one-hot class + vector columns, joined on ``key``."""
    b = one_hot(base, class_col, class_prefix, class_values) if class_col else base
    return wide_vectors(b.join(vectors, key), vec_col, n_dims)


def assemble(df: DataFrame, exclude: list[str], out: str = "features") -> DataFrame:
    """Model input vector from every column not excluded (VectorAssembler)."""
    from pyspark.ml.feature import VectorAssembler
    cols = [c for c in df.columns if c not in exclude]
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def column(col) -> Column:
    return F.col(col) if isinstance(col, str) else col
