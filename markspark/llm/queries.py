"""The registered queries of the training-data operators, each over its whole tables, and their DuckDB twins."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markspark.llm import (bpe, decontaminate, filter_audit, licenses, line_dedup, near_dup, quality, shards, spelling, suffix_tree,
                           token_rollup, topk, toxicity)
from markspark.llm.common import scratch_path, ship_code, stored, table

#: Low enough for a passage with some 20 copies of which a hot source holds half; copies on fewer sites are left to near-dedup.
MIN_SITES = 5


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file, the same on every machine that has the package."""
    spec = importlib.util.find_spec("public_tokenizers")
    return str(Path(spec.origin).parent / name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    net = toxicity.fit(docs, labels.filter(rest != 0))
    return toxicity.scores(docs, net).select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "score",
                                             (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = line_dedup.dedup_lines(docs, "source", MIN_SITES)
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), "text")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    n_hit = decontaminate.covered()
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.shard_rows(table(spark, sf_dir, "documents"), "doc_id", "text", n_shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def files(docs: DataFrame) -> DataFrame:
    """Documents as files (path, text): a folder for each source, language and thousand of ids; a document
    whose last line speaks of a licence is its folder's licence file."""
    last = F.lower(F.substring_index("text", "\n", -1))
    name = F.when(last.contains("licen"), F.lit("LICENSE-")).otherwise(F.lit("doc-"))
    folder = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"))
    return docs.select("doc_id", F.concat(folder, F.lit("/"), F.coalesce(name, F.lit("doc-")), F.col("doc_id").cast("string")).alias("path"), "text")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(files(table(spark, sf_dir, "documents")), least=0.6, carry=("doc_id",))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = "word_bpe_49k", "byte_bpe_multi_50k"
    counts = stored(token_rollup.token_counts(table(spark, sf_dir, "documents"), vocabulary(f"{first}.json"),
                                              vocabulary(f"{second}.tiktoken")), "counts")
    rollup = token_rollup.Rollup(spark, scratch_path(spark, "rollup"))
    token_rollup.maintain_all(rollup, counts, first, second)
    return rollup.totals()


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.select_quality(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.col("__log_weight").alias("log_weight"), F.col("__key").alias("key"), F.col("__selected").alias("selected"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents"), vocabulary())
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7))
    docs = docs.select("doc_id", "text", F.coalesce(rest != 2, F.lit(False)).alias("learn"))
    tree = suffix_tree.fit(docs.filter("learn").select(F.coalesce("text", F.lit("")).alias("text")))
    return suffix_tree.score(docs, tree).select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
                                                "train_tokens", "base_score", "score")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), filter_audit.text_failures(F.col("__text")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _ready(fn) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_code(spark)
        return fn(spark, sf_dir)

    run.__name__ = fn.__name__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_toxicity, op2_line_dedup, op3_decontamination, op4_topk, op5_shards, op6_licenses, op7_near_dup,
             op8_token_counts, op9_quality, op10_bpe, op11_lm_score, op12_spelling, op13_filter_audit, pipeline]
    return {f.__name__: _ready(f) for f in found}


_OP2 = f"""
WITH l AS (SELECT doc_id, source, generate_subscripts(a, 1) AS pos, unnest(a) AS line
           FROM (SELECT doc_id, source, string_split(text, chr(10)) AS a FROM documents)),
b AS (SELECT trim(line, ' ') AS t, min(doc_id) AS first_id FROM l WHERE trim(line, ' ') <> ''
      GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}),
m AS (SELECT l.doc_id, l.pos, l.line, trim(l.line, ' ') <> '' AS is_line, coalesce(b.first_id <> l.doc_id, false) AS gone
      FROM l LEFT JOIN b ON trim(l.line, ' ') = b.t)
SELECT d.doc_id, coalesce(x.n_lines, 0) AS n_lines, coalesce(x.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(x.text, '') END AS text
FROM documents d LEFT JOIN (SELECT doc_id, count(*) FILTER (is_line) AS n_lines, count(*) FILTER (gone) AS n_removed,
       string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS text FROM m GROUP BY doc_id) x USING (doc_id)
"""

_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP3 = f"""
WITH iw AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw),
hits AS (SELECT p.doc_id, p.i, win.n, win.item_id FROM (SELECT doc_id, i, s.n, array_to_string(w[i:i + s.n - 1], ' ') AS g
         FROM pos, (SELECT DISTINCT n FROM win) s WHERE i + s.n - 1 <= len(w)) p JOIN win ON win.n = p.n AND win.g = p.g),
cov AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
        FROM hits GROUP BY 1)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_OP4 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

_OP7 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
         JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
         GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""


_OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
             + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
      FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order FROM x a, x b, x c, x d, x e
      WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, step, x.name, x.bit, (SELECT coalesce(sum(y.bit), 0) FROM x y
             WHERE position(y.name IN left(filter_order, (step - 1)::INT)) > 0)::INT AS before
      FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) JOIN x ON x.name = substr(filter_order, step, 1)),
p AS (SELECT DISTINCT part FROM c),
r AS (SELECT p.part, filter_order, step::INT AS step, name,
             coalesce(sum(n) FILTER ((mask & (before | bit)) = 0), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER ((mask & before) <> 0 AND (mask & bit) <> 0), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0)::BIGINT AS good_lost,
             coalesce(sum(toxic) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0)::BIGINT AS toxic_lost
      FROM p JOIN c USING (part), s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, name))::BIGINT AS shapley FROM r
"""


def oracle_sql() -> dict[str, str]:
    """Twins where SQL can express the operator."""
    return {"op2_line_dedup": _OP2, "op3_decontamination": _OP3, "op4_topk": _OP4, "op7_near_dup": _OP7, "op13_filter_audit": _OP13}
