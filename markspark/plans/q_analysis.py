"""Robustness and analysis queries: court-decision strata, sampling, publication
delays (L4, P15, E16, A9-A11, A14, A16, W3-W12, W17, U2, F14-F16, M8)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from markspark.functions.numeric import round_even
from markspark.operators import bucket, clean, joins, label, sample, stats
from markspark.operators import evaluate as ev
from markspark.plans import adapters as ad
from markspark.plans.oracle import CTE, with_
from markspark.plans.registry import query
from markspark.plans.sqlkit import SCORE_KEYS, dbl, dlist, r9, sr9
from markspark.session import stored_rows

KEY = ad.SCORE_KEY
SEED = 42

CTE["court_mt"] = """
select *, case when contains(court_text, 'arbitrary') then 'arbitrary'
  when contains(court_text, 'fanciful') then 'fanciful'
  when contains(court_text, 'suggestive') or contains(court_text, 'suggesitve') then 'suggestive'
  when contains(court_text, 'descriptive') then 'descriptive'
  when contains(court_text, 'generic') then 'generic' else 'none' end as mark_type
from court"""
COURT = ["court", "court_mt"]


def court_mt(spark, sf):
    return ad.court_decisions(spark, sf).withColumn("mark_type", label.mark_type("court_text"))


@query("mark_type", "L4 A9", with_(COURT, "select mark_type, count(*) as n from court_mt group by mark_type"))
def q_mark_type(spark, sf):
    return stats.group_count(court_mt(spark, sf), ["mark_type"])


OVERRIDE = {"small ring": 1, "red widget": 0}


@query("override_label", "P15", with_(COURT, """
select row_id, mark, case when mark = 'small ring' then 1 when mark = 'red widget' then 0 else distinct_ind end
  as distinct_ind from court"""))
def q_override_label(spark, sf):
    c = clean.override(ad.court_decisions(spark, sf), "mark", "distinct_ind", OVERRIDE)
    return c.select("row_id", "mark", F.col("distinct_ind").cast("int"))


_STEPS = ev.arange(0.0, 1.0, 0.01)


@query("stratum_sweep", "E16 Q4", with_(COURT, f"""
select stratum, threshold,
  round_even(cast(count_if(cast(model_probs >= threshold as integer) = lab) as bigint) * 100.0::double / count(*), 2) as perf
from (select mark_type as stratum, model_probs, min(distinct_ind) over (partition by mark_type) as lab from court_mt) c,
     (select unnest({dlist(_STEPS)}) as threshold) t
group by stratum, threshold"""))
def q_stratum_sweep(spark, sf):
    return ev.stratum_threshold_sweep(court_mt(spark, sf), "mark_type", "model_probs", "distinct_ind", 100)


@query("stratum_stats", "A10", with_(COURT, f"""
select mark_type, {r9('avg(model_probs)')} as mean, {r9('stddev_samp(model_probs)')} as std
from court_mt group by mark_type"""))
def q_stratum_stats(spark, sf):
    g = stats.group_stats(court_mt(spark, sf), ["mark_type"], "model_probs")
    return g.select("mark_type", sr9(F.col("mean")).alias("mean"), sr9(F.col("std")).alias("std"))


@query("stratum_box", "A11", with_(COURT, f"""
select mark_type, n, {r9('q[1]')} as min, {r9('q[2]')} as q1, {r9('q[3]')} as median, {r9('q[4]')} as q3,
  {r9('q[5]')} as max, {r9('q[2] - 1.5::double * (q[4] - q[2])')} as whisker_lo,
  {r9('q[4] + 1.5::double * (q[4] - q[2])')} as whisker_hi
from (select mark_type, count(model_probs) as n,
        quantile_cont(model_probs, [0.0::double, 0.25::double, 0.5::double, 0.75::double, 1.0::double]) as q
      from court_mt group by mark_type) t"""))
def q_stratum_box(spark, sf):
    b = stats.box_stats(court_mt(spark, sf), ["mark_type"], "model_probs")
    cols = ["min", "q1", "median", "q3", "max", "whisker_lo", "whisker_hi"]
    return b.select("mark_type", "n", *[sr9(F.col(c)).alias(c) for c in cols])


@query("stratum_ci", "A14", with_(COURT, f"""
select mark_type, count(model_probs) as n, {r9('avg(model_probs)')} as mean, {r9('stddev_samp(model_probs)')} as std,
  {r9('avg(model_probs) - 1.96::double * stddev_samp(model_probs) / sqrt(count(model_probs))')} as ci_lo,
  {r9('avg(model_probs) + 1.96::double * stddev_samp(model_probs) / sqrt(count(model_probs))')} as ci_hi
from court_mt group by mark_type"""))
def q_stratum_ci(spark, sf):
    m = stats.mean_ci(court_mt(spark, sf), ["mark_type"], "model_probs")
    return m.select("mark_type", "n", *[sr9(F.col(c)).alias(c) for c in ("mean", "std", "ci_lo", "ci_hi")])


@query("balanced_sample", "W10 W9", with_(COURT, f"""
select row_id, mark_type from court_mt
qualify row_number() over (partition by mark_type order by md5(concat_ws('|', '{SEED}', cast(row_id as varchar))), row_id)
  <= (select min(c) from (select count(*) as c from court_mt group by mark_type) m)"""))
def q_balanced_sample(spark, sf):
    return sample.balanced_sample(court_mt(spark, sf), ["mark_type"], SEED, ["row_id"]).select("row_id", "mark_type")


@query("union_strata", "U2", with_(COURT, """
select row_id, mark_type from court_mt"""))
def q_union_strata(spark, sf):
    c = court_mt(spark, sf).select("row_id", "mark_type")
    strata = [r.mark_type for r in c.select("mark_type").distinct().collect()]  # one row a stratum
    return joins.union_all([c.filter(F.col("mark_type").eqNullSafe(F.lit(m))) for m in strata])


@query("seeded_shuffle_head", "W11 W17", with_(COURT, f"""
select row_id, mark from court order by md5(concat_ws('|', '{SEED}', cast(row_id as varchar))), row_id limit 20"""))
def q_seeded_shuffle_head(spark, sf):
    return sample.shuffle(ad.court_decisions(spark, sf), SEED, ["row_id"]).select("row_id", "mark").limit(20)


def _cut_sql(col: str, edges: list[float]) -> str:
    cases = " ".join(f"when {col} > {dbl(edges[i])} and {col} <= {dbl(edges[i + 1])} then {i + 1}"
                     for i in range(len(edges) - 1))
    return f"case {cases} end"


CTE["correct"] = "select * from scored where label = pred"
CTE["correct_bins"] = f"""
select *, {_cut_sql('prob', bucket.EDGES_27)} as bin from correct"""
CTE["correct_bins23"] = f"""
select *, {_cut_sql('prob', bucket.EDGES_23)} as bin from correct"""


@query("interval_counts", "W3 P14 W12", with_(["scored", "correct", "correct_bins"], f"""
select bin, {dlist(bucket.EDGES_27[:-1])}[bin] as bin_lo, {dlist(bucket.EDGES_27[1:])}[bin] as bin_hi, count(*) as n,
  cast(row_number() over (order by bin) as integer) as place from correct_bins group by bin"""))
def q_interval_counts(spark, sf):
    c = bucket.cut(clean.correct_only(ad.scored(spark, sf)), "prob", bucket.EDGES_27)
    n = c.groupBy("bin", "bin_lo", "bin_hi").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy("bin"))).orderBy("bin")  # one row an interval


def _interval_sample(spark, sf, edges, n):
    # bins are contiguous: "has a bin" is the outer range (a cheap predicate
    # that the optimizer can push below the bin expression)
    s = clean.correct_only(ad.scored(spark, sf))
    s = s.filter((F.col("prob") > F.lit(float(edges[0]))) & (F.col("prob") <= F.lit(float(edges[-1]))))
    c = bucket.cut(s, "prob", edges)
    s = sample.sample_per_group(c, ["bin"], n, SEED, KEY, tie=["prob"])
    return s.select(*KEY, "bin", round_even(F.col("prob"), 4).alias("prob"))


def _sample_sql(src, n):
    keys = ", ".join(f"cast({k} as varchar)" for k in KEY)
    return f"""
select {SCORE_KEYS}, bin, round_even(prob, 4) as prob from {src} where bin is not null
qualify row_number() over (partition by bin order by md5(concat_ws('|', '{SEED}', {keys})), {SCORE_KEYS}, prob) <= {n}"""


@query("interval_sample", "W9 W3 P14", with_(["scored", "correct", "correct_bins"], _sample_sql("correct_bins", 5)))
def q_interval_sample(spark, sf):
    return _interval_sample(spark, sf, bucket.EDGES_27, 5)


@query("interval_sample_wide", "W9 W3", with_(["scored", "correct", "correct_bins23"], _sample_sql("correct_bins23", 100)))
def q_interval_sample_wide(spark, sf):
    return _interval_sample(spark, sf, bucket.EDGES_23, 100)


DELAY = ["scored", "delays"]


def _delays(spark, sf):
    return clean.row_filter(ad.delays(spark, sf), F.col("delay").isNotNull())


@query("delay_table", "F14 P16 J8", with_(DELAY, f"""
select {SCORE_KEYS}, filing_dt, publication_dt, delay, prob from delays where delay is not null"""))
def q_delay_table(spark, sf):
    return _delays(spark, sf).select(*KEY, "filing_dt", "publication_dt", "delay", "prob")


@query("delay_norm", "W7 W8", with_(DELAY, f"""
select {SCORE_KEYS}, {r9('(delay - mn_d) / (mx_d - mn_d)')} as delay_norm, {r9('(prob - mn_p) / (mx_p - mn_p)')} as prob_norm,
  {r9('(delay - av_d) / sd_d')} as delay_std, {r9('(prob - av_p) / sd_p')} as prob_std
from delays, (select min(delay) as mn_d, max(delay) as mx_d, min(prob) as mn_p, max(prob) as mx_p,
                     avg(delay) as av_d, stddev_samp(delay) as sd_d, avg(prob) as av_p, stddev_samp(prob) as sd_p
              from delays where delay is not null) s
where delay is not null"""))
def q_delay_norm(spark, sf):
    cols = ["delay", "prob"]
    # the joined rows are stored: the figures and the result read them, and the join is made once
    joined = stored_rows(_delays(spark, sf).select(*KEY, *cols))
    found = bucket.scale_stats(joined, cols)
    d = bucket.zscore(bucket.minmax(joined, cols, found=found), cols, found=found)
    return d.select(*KEY, *[sr9(F.col(c)).alias(c) for c in ("delay_norm", "prob_norm", "delay_std", "prob_std")])


_Q10 = ev.arange(0.0, 1.01, 0.1)


def _qcut_sql(col: str) -> str:
    return f"""
select bin, edges[bin] as qbin_lo, edges[bin + 1] as qbin_hi, count(*) as n,
  {r9('avg(prob)')} as mean_prob, {r9('avg(delay)')} as mean_delay
from (select d.*, e.edges, cast(greatest(1, len(list_filter(e.edges, lambda x: x < d.{col}))) as integer) as bin
      from delays d, (select list_sort(list_distinct(quantile_cont({col}, {dlist(_Q10)}))) as edges
                      from delays where delay is not null) e
      where d.delay is not null) b
group by bin, edges"""


def _qcut_spark(spark, sf, col):
    g = bucket.qcut_mean(_delays(spark, sf), col, _Q10, ["prob", "delay"], prefix="bin")
    return g.select("bin", F.col("bin_lo").alias("qbin_lo"), F.col("bin_hi").alias("qbin_hi"), "n",
                    sr9(F.col("mean_prob")).alias("mean_prob"), sr9(F.col("mean_delay")).alias("mean_delay"))


@query("delay_deciles", "W4 A16", with_(DELAY, _qcut_sql("delay")))
def q_delay_deciles(spark, sf):
    return _qcut_spark(spark, sf, "delay")


@query("prob_deciles", "W4 A16", with_(DELAY, _qcut_sql("prob")))
def q_prob_deciles(spark, sf):
    return _qcut_spark(spark, sf, "prob")


@query("delay_histogram", "W6 W5", with_(DELAY, """
select bin, lo + bin * ((hi - lo) / nb) as lo, lo + (bin + 1) * ((hi - lo) / nb) as hi, count(*) as n
from (select cast(least(floor((delay::double - lo) * nb / (hi - lo)), nb - 1) as integer) as bin, lo, hi, nb
      from delays, (select min(delay)::double as lo, max(delay)::double as hi,
                           greatest(floor((max(delay)::double - min(delay)::double) / 10.0::double), 1)::double as nb
                    from delays where delay is not null) mm
      where delay is not null) b
group by bin, lo, hi, nb"""))
def q_delay_histogram(spark, sf):
    return bucket.histogram(_delays(spark, sf), "delay", width=10)


@query("delay_fit", "M8 F15", with_(DELAY, f"""
select {r9('regr_slope(prob, ln(delay))', 6)} as slope, {r9('regr_intercept(prob, ln(delay))', 6)} as intercept,
  cast(regr_count(prob, ln(delay)) as bigint) as n from delays where delay > 0"""))
def q_delay_fit(spark, sf):
    from markspark.functions.numeric import safe_ln
    d = _delays(spark, sf).filter(F.col("delay") > 0).withColumn("ln_delay", safe_ln("delay"))
    r = stats.reg_line(d, "ln_delay", "prob")
    return r.select(sr9(F.col("slope"), 6).alias("slope"), sr9(F.col("intercept"), 6).alias("intercept"),
                    F.col("n").cast("bigint"))


@query("delay_mean", "A16 A14", with_(DELAY, f"""
select delay, count(prob) as n, {r9('avg(prob)')} as mean, {r9('stddev_samp(prob)')} as std,
  {r9('avg(prob) - 1.96::double * stddev_samp(prob) / sqrt(count(prob))')} as ci_lo,
  {r9('avg(prob) + 1.96::double * stddev_samp(prob) / sqrt(count(prob))')} as ci_hi
from delays where delay is not null group by delay"""))
def q_delay_mean(spark, sf):
    m = stats.mean_by(_delays(spark, sf), "delay", "prob")
    return m.select("delay", "n", *[sr9(F.col(c)).alias(c) for c in ("mean", "std", "ci_lo", "ci_hi")])


@query("court_model_input", "F6 F4", with_(COURT, """
select row_id, '[CLS] ' || mark || ' [SEP] ' || description || ' [SEP] ' || 'Nice class is ' || cast(nice_class as varchar)
  as model_input from court"""))
def q_court_model_input(spark, sf):
    from markspark.functions.templates import model_input
    from markspark.functions.text import indicator_text
    c = ad.court_decisions(spark, sf).withColumn("nice_class_text", indicator_text("nice_class", "Nice class is "))
    return c.select("row_id", model_input("short", "cls").alias("model_input"))
