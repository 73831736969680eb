"""Adapters from the driver's test tables to the engine's logical tables.

The test data is a retail star schema, not case files; each adapter is a
plain Spark projection/aggregation of a driver table, so the work of every
query grows with the tables. The same derivations are written as SQL views
in :mod:`markspark.plans.oracle` for the DuckDB cross-check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markspark.functions.numeric import md5_unit
from markspark.sources.tables import load

# Class codes given to order priorities; two carry codes the
# cleaning step excludes.
PRIORITY_CODES = {"1-URGENT": "9", "2-HIGH": "16", "3-MEDIUM": "25",
                  "4-NOT SPECIFIED": "A", "5-LOW": "200"}

# Court text per part type (includes the misspelling the
# classifier must accept, and one text that matches no class word).
COURT_TEXT = {"ECONOMY": "generic", "LARGE": "descriptive", "MEDIUM": "suggesitve",
              "PROMO": "arbitrary", "SMALL": "fanciful", "STANDARD": "other"}

SCORE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _map(col: str, mapping: dict) -> F.Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(F.col(col) == k, v) if expr is None else expr.when(F.col(col) == k, v)
    return expr


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """Case files from ``orders``."""
    return cases_from(load(spark, sf, "orders"))


def cases_from(o: DataFrame) -> DataFrame:
    """Case files from an ``orders`` frame (possibly already filtered)."""
    filing = F.to_date("o_orderdate")
    pub = F.col("o_orderstatus").isin("F", "P")
    return o.select(
        F.col("o_orderkey").alias("serial_no"),
        filing.alias("filing_dt"),
        F.when(pub, F.date_add(filing, (F.col("o_orderkey") % 60).cast("int"))).alias("publication_dt"),
        F.when(F.col("o_orderstatus") == "F", F.date_add(filing, (F.col("o_orderkey") % 60 + 90).cast("int"))).alias("registration_dt"),
        F.concat(F.lit("Mark "), F.col("o_custkey").cast("string"), F.lit("-"),
                 (F.col("o_orderkey") % 5).cast("string")).alias("mark_id_char"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("acq_dist_in"),
        (F.col("o_orderpriority") == "2-HIGH").cast("int").alias("acq_dist_part_in"),
        ((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P")).cast("int").alias("supp_reg_in"),
    )


def office_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Office-action sums per case from ``lineitem`` (orders without lines: none)."""
    li = load(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("serial_no")).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("descriptive_sum"),
        F.count_if(F.col("l_discount") >= F.lit(0.09)).alias("generic_sum"))


def designs(spark: SparkSession, sf: str) -> DataFrame:
    """Design rows: one per line with quantity >= 49 (repeated keys kept)."""
    li = load(spark, sf, "lineitem")
    return li.filter(F.col("l_quantity") >= F.lit(49.0)).select(F.col("l_orderkey").alias("serial_no"))


def classes(spark: SparkSession, sf: str) -> DataFrame:
    """Class rows per case from ``orders``: one code from the priority, and a
    second row (code 'B') for open orders, which the exactly-one rule drops."""
    o = load(spark, sf, "orders")
    first = o.select(F.col("o_orderkey").alias("serial_no"),
                     _map("o_orderpriority", PRIORITY_CODES).alias("intl_class_cd"))
    second = o.filter(F.col("o_orderstatus") == "O").select(
        F.col("o_orderkey").alias("serial_no"), F.lit("B").alias("intl_class_cd"))
    return first.unionByName(second)


def statements(spark: SparkSession, sf: str) -> DataFrame:
    """Statements from ``conversations`` (type code = role, order = turn)."""
    c = load(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("serial_no"), F.col("turn").alias("seq"),
                    F.col("role").alias("statement_type_cd"), F.col("text").alias("statement_text"))


def nice_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    """Class description lookup from ``nation`` (class = nation key + 1)."""
    n = load(spark, sf, "nation")
    return n.select((F.col("n_nationkey") + 1).alias("Class"),
                    F.concat(F.col("n_name"), F.lit(", Goods & Services!")).alias("Description"))


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Lexicon: distinct lower-case whitespace tokens of ``benchmark.text``."""
    b = load(spark, sf, "benchmark")
    return b.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("token")).filter("token <> ''").distinct()


def translations(spark: SparkSession, sf: str) -> DataFrame:
    """Translations keyed by (case, filing date); every third is the sentinel."""
    o = load(spark, sf, "orders")
    k = F.col("o_orderkey") % 3
    cust = F.col("o_custkey").cast("string")
    t = (F.when(k == 0, F.lit("-1"))
         .when(k == 1, F.concat(F.lit("mark "), cust, F.lit(" ")))
         .otherwise(F.concat(F.lit("Marque "), cust)))
    return o.select(F.col("o_orderkey").alias("serial_no"), F.to_date("o_orderdate").alias("filing_dt"),
                    t.alias("mark_translated"))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rows from ``lineitem``: two logits, probability, label, argmax."""
    li = load(spark, sf, "lineitem")
    z1 = F.round((F.col("l_quantity") - F.lit(25.5)) / F.lit(12.5) + F.lit(10.0) * (F.col("l_discount") - F.lit(0.05)), 6)
    s = li.select(*SCORE_KEY, "l_returnflag", "l_linestatus", "l_shipdate", "l_tax", "l_quantity",
                  z1.alias("logit_1"))
    s = s.withColumn("logit_0", F.round(F.lit(-0.8) * F.col("logit_1") + F.col("l_tax"), 6))
    s = s.withColumn("prob", F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("logit_1"))), 6))
    s = s.withColumn("label", (F.col("l_returnflag").isin("R", "A") & (F.col("l_quantity") >= F.lit(20.0))).cast("int"))
    s = s.withColumn("pred", (F.col("logit_1") > F.col("logit_0")).cast("int"))
    return s.select(*SCORE_KEY, "label", "logit_0", "logit_1", "prob", "pred", "l_returnflag", "l_linestatus", "l_shipdate")


def court_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Court-decision rows from ``part``: mark, description, class, court text, model output."""
    p = load(spark, sf, "part")
    z = (F.col("p_retailprice") - F.lit(1400.0)) / F.lit(300.0) + (F.col("p_size") - F.lit(25.0)) / F.lit(20.0)
    prob = F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 6)
    return p.select(
        F.col("p_partkey").alias("row_id"),
        F.col("p_name").alias("mark"),
        F.col("p_brand").alias("description"),
        F.col("p_size").alias("nice_class"),
        _map("p_type", COURT_TEXT).alias("court_text"),
        F.when(F.col("p_type").isin("ECONOMY", "LARGE"), 0).otherwise(1).alias("distinct_ind"),
        prob.alias("model_probs"),
        (prob >= F.lit(0.5)).cast("int").alias("model_preds"))


def delays(spark: SparkSession, sf: str) -> DataFrame:
    """Delay rows: ship-date minus order-date per line, with the line's probability."""
    s = scored(spark, sf).select(*SCORE_KEY, "prob", "label", "l_shipdate")
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    j = s.join(o, s.l_orderkey == o.o_orderkey)
    return j.select(*SCORE_KEY, F.to_date("o_orderdate").alias("filing_dt"),
                    F.to_date("l_shipdate").alias("publication_dt"), "prob", "label",
                    F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("delay"))


def word_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Word vectors: each lexicon token gets the embedding md5(token) mod #vectors."""
    e = load(spark, sf, "embeddings")
    lex = lexicon(spark, sf)
    n = e.count()  # one scalar
    tagged = lex.withColumn("vec_id", md5_unit(F.col("token")) % F.lit(n))
    return tagged.join(e.select("vec_id", "embedding"), "vec_id").select("token", F.col("embedding").alias("vector"))


def subword_pieces(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Sub-word pieces of ``part.p_name``: words cut after 3 characters, a blank
    closing every word but the last, plus an empty piece at both ends.
    Returns (texts(doc_id, text), pieces(doc_id, pos, piece, score))."""
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))
    w = p.select("doc_id", F.size(F.split("text", " ")).alias("_nw"),
                 F.posexplode(F.split("text", " ")).alias("_wp", "_w"))
    c = w.select("doc_id", "_nw", "_wp", F.posexplode(F.regexp_extract_all("_w", F.lit(".{1,3}"), 0)).alias("_cp", "_c"),
                 F.size(F.regexp_extract_all("_w", F.lit(".{1,3}"), 0)).alias("_nc"))
    piece = F.when((F.col("_cp") == F.col("_nc") - 1) & (F.col("_wp") < F.col("_nw") - 1),
                   F.concat("_c", F.lit(" "))).otherwise(F.col("_c"))
    mid = c.select("doc_id", (F.col("_wp") * 100 + F.col("_cp") + 1).alias("pos"), piece.alias("piece"))
    ends = p.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1000000))).alias("pos"), F.lit("").alias("piece"))
    pieces = mid.unionByName(ends)
    score = (md5_unit(F.col("doc_id"), F.col("pos")) % 1000).cast("double") / F.lit(1000.0) - F.lit(0.5)
    pieces = pieces.withColumn("score", F.when(F.col("piece") == "", F.lit(0.0)).otherwise(score))
    return p, pieces
