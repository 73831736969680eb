"""Operator 4: exact top-k inner products over vectors sorted by length.

Components become integers floor(scale * x), so scores are exact. Vectors are
sorted by descending length across the cluster and packed into blocks; the
Gram matrix of all vectors (one small matrix a task, summed) gives an SVD
basis in which the leading coordinates carry most of every vector. A query
block meets a candidate block as follows:

* whole block: skipped where |q| times the block's greatest length cannot
  reach the query's threshold (Cauchy-Schwarz on whole vectors);
* partial sums over the leading rotated coordinates plus the product of the
  residual lengths bound each score from above; only candidates whose bound
  reaches the threshold are scored exactly, in integers.

A query's threshold is its k-th best score among the ``SEEDS`` longest vectors
and rises while a block is worked through. Queries are a stated set, taken in
blocks against all candidate blocks; nothing is sampled and every candidate is
either scored or bounded below the k-th best.

Defined results: vectors that are null, empty, of another dimension than most,
or hold null or non-finite components take no part; a row with a null id takes
none either. The id names a row: rows under the query's own id are not its
candidates, and rows repeated under one id with one vector count once. Fewer
than k candidates: all of them. Scores must fit a 64-bit integer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from markspark.llm.common import stored

QUERY_BLOCK, CANDIDATE_BLOCK, STEP = 512, 4096, 512
#: The longest vectors, whose scores give the first thresholds (collected: SEEDS x dimension integers).
SEEDS = 1024
LEADING = 16


def _integers(batch, scale: float):
    """ids and integer vectors (rows of one dimension each) of the valid rows."""
    ids, vecs = batch.column(0), batch.column(1)
    lengths = np.array([len(v) if v is not None else 0 for v in vecs.to_pylist()]) if not pa.types.is_list(vecs.type) else None
    if lengths is None:
        lengths = np.nan_to_num(np.asarray(vecs.value_lengths().to_numpy(zero_copy_only=False), float)).astype(int)
    flat = vecs.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
    ok = np.isfinite(x)
    at = np.concatenate([[0], np.cumsum(lengths)])
    key = ids.to_numpy(zero_copy_only=False)
    for r in range(len(ids)):
        a, b = at[r], at[r + 1]
        if b > a and ids[r].is_valid and ok[a:b].all():
            yield int(key[r]), np.floor(scale * x[a:b]).astype(np.int64)


def integer_vectors(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, dim, norm2, v): valid rows, v the integers' bytes, norm2 the squared length."""
    def run(batches):
        for batch in batches:
            rows = list(_integers(batch, scale))
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in rows], pa.int64()), pa.array([len(v) for _, v in rows], pa.int32()),
                 pa.array([float(np.square(v.astype(np.float64)).sum()) for _, v in rows], pa.float64()),
                 pa.array([v.tobytes() for _, v in rows], pa.binary())], names=["vec_id", "dim", "norm2", "v"])

    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return src.mapInArrow(run, "vec_id long, dim int, norm2 double, v binary")


def _matrix(blobs, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.int64).reshape(-1, dim)


def _rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all vectors, from the sum of the tasks' Gram matrices."""
    def gram(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column(0).to_pylist(), dim).astype(np.float64)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    def add(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            for g in batch.column(0).to_pylist():
                total += np.frombuffer(g).reshape(dim, dim)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    parts = rows.select("v").mapInArrow(gram, "g binary")
    total = np.zeros((dim, dim))
    for r in parts.coalesce(32).mapInArrow(add, "g binary").collect():  # 32 small matrices at most
        total += np.frombuffer(r.g).reshape(dim, dim)
    return np.linalg.eigh(total)[1][:, ::-1].copy()


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores first, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _scores(q: np.ndarray, x: np.ndarray, tile: np.ndarray | None, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the pairs (q[row], x[col]); ``tile``: all of them, where doubles hold them exactly."""
    if tile is not None:
        return tile[row, col].astype(np.int64)
    return np.concatenate([(q[row[a:a + 16384]] * x[col[a:a + 16384]]).sum(1) for a in range(0, len(row), 16384)])


def _block_top(qid, q, t, cid, c, rot, k, lead):
    """(query place, candidate id, score): each query's k best of one norm-sorted candidate block."""
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    qr, cr = qf @ rot, cf @ rot
    qn, cn = np.sqrt((qf * qf).sum(1)), np.sqrt((cf * cf).sum(1))
    q_rest = np.sqrt(np.maximum((qr[:, lead:] ** 2).sum(1), 0))
    c_rest = np.sqrt(np.maximum((cr[:, lead:] ** 2).sum(1), 0))
    slack = 1e-9 * qn.max(initial=0) * cn.max(initial=0) + 1e-6  # rounding of the rotated sums
    t = t.copy()
    best_s, best_i = [np.zeros(0, np.int64)] * len(q), [np.zeros(0, np.int64)] * len(q)
    for a in range(0, len(c), STEP):
        b = min(a + STEP, len(c))
        live = np.flatnonzero(qn * cn[a] + slack >= t)  # cn[a] is the greatest length from here on
        if not len(live):
            break
        bound = qr[live, :lead] @ cr[a:b, :lead].T + np.outer(q_rest[live], c_rest[a:b]) + slack
        row, col = np.nonzero((bound >= t[live, None]) & (qid[live, None] != cid[None, a:b]))
        if not len(row):
            continue
        tile = qf[live] @ cf[a:b].T if qn.max() * cn.max() < 2 ** 52 else None
        score = _scores(q[live], c[a:b], tile, row, col)
        cuts = np.flatnonzero(np.diff(row)) + 1
        for part in np.split(np.arange(len(row)), cuts):
            i = live[row[part[0]]]
            s, n = np.concatenate([best_s[i], score[part]]), np.concatenate([best_i[i], cid[a + col[part]]])
            keep = _best(s, n, k)
            best_s[i], best_i[i] = s[keep], n[keep]
            if len(keep) == k:
                t[i] = max(t[i], float(s[keep[-1]]))
    return [(i, n, s) for i in range(len(q)) for n, s in zip(best_i[i].tolist(), best_s[i].tolist(), strict=True)]


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors(vec_id, embedding)`` where ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, scale).dropDuplicates(["vec_id", "v"])
    rows = stored(rows, "vectors")
    dims = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not dims:
        return empty
    dim = dims[0].dim
    rows = rows.filter(F.col("dim") == dim)
    rot = _rotation(rows, dim)
    lead = min(LEADING, dim)
    seeds = rows.orderBy(F.desc("norm2"), "vec_id", "v").limit(SEEDS).collect()
    shared = spark.sparkContext.broadcast((rot, np.array([s.vec_id for s in seeds]), _matrix([s.v for s in seeds], dim)))

    def pack_queries(batches):
        _, sid, seed = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(a, QUERY_BLOCK)
                qid, q = part.column(0).to_numpy(), _matrix(part.column(1).to_pylist(), dim)
                t = np.full(len(q), -np.inf)
                for i in range(len(q)):
                    s = np.sort((seed[sid != qid[i]] * q[i]).sum(1))
                    if len(s) >= k:
                        t[i] = float(s[-k])
                reach = float(np.min(t / np.maximum(np.sqrt((q.astype(float) ** 2).sum(1)), 1e-12)))
                yield pa.RecordBatch.from_arrays([pa.array([qid.astype(np.int64).tobytes()]), pa.array([q.tobytes()]),
                                                  pa.array([t.tobytes()]), pa.array([reach])], names=["qid", "q", "t", "reach"])

    def pack_candidates(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, CANDIDATE_BLOCK):
                part = batch.slice(a, CANDIDATE_BLOCK)
                yield pa.RecordBatch.from_arrays(
                    [part.column(3).slice(0, 1), pa.array([part.column(0).to_numpy().astype(np.int64).tobytes()]),
                     pa.array([b"".join(part.column(1).to_pylist())]), pa.array([float(np.sqrt(part.column(2)[0].as_py()))])],
                    names=["place", "cid", "c", "longest"])

    def match(batches):
        rot = shared.value[0]
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                qid = np.frombuffer(batch.column(0)[r].as_py(), np.int64)
                q, t = _matrix([batch.column(1)[r].as_py()], dim), np.frombuffer(batch.column(2)[r].as_py())
                cid, c = np.frombuffer(batch.column(3)[r].as_py(), np.int64), _matrix([batch.column(4)[r].as_py()], dim)
                out += [(int(qid[i]), n, s) for i, n, s in _block_top(qid, q, t, cid, c, rot, k, lead)]
            if out:
                a, b, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())],
                                                 names=["query_id", "vec_id", "score"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    queries = rows.filter(is_query).select("vec_id", "v").mapInArrow(pack_queries, "qid binary, q binary, t binary, reach double")
    # every query block is sent to every place a candidate block can have: a stated query set in blocks
    queries = queries.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    ordered = rows.repartitionByRange(parts, F.desc("norm2"), "vec_id", "v").sortWithinPartitions(F.desc("norm2"), "vec_id", "v")
    blocks = (ordered.select("vec_id", "v", "norm2", F.spark_partition_id().alias("place"))
              .mapInArrow(pack_candidates, "place int, cid binary, c binary, longest double"))
    pairs = (queries.join(blocks, "place").filter(F.col("longest") * (1 + 1e-9) >= F.col("reach"))
             .select("qid", "q", "t", "cid", "c"))
    found = pairs.mapInArrow(match, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
