"""Evaluation queries over the scored table (E1-E19, W2, W5, P12, F12, F13,
L5, L6, A12-A14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from markspark.functions.numeric import round_even
from markspark.operators import bootstrap as bs
from markspark.operators import calibrate as cal
from markspark.operators import evaluate as ev
from markspark.operators import order, resample
from markspark.operators.bucket import histogram
from markspark.plans import adapters as ad
from markspark.plans.oracle import CTE, with_
from markspark.plans.registry import query
from markspark.plans.sqlkit import SCORE_KEYS, counts_sql, dbl, dlist, r9, report_sql, roc_sql, sr9
from markspark.sources.tables import load

KEY = ad.SCORE_KEY
TEMP_GRID = [0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0]
FIXED_T = 0.75
BOOT_ROUNDS, BOOT_SEED = 30, 42


def _scored(spark, sf):
    return ad.scored(spark, sf)


@query("confusion", "E1", with_(["scored"], """
select label, pred, count(*) as n, count(*) / sum(count(*)) over () as share from scored group by label, pred"""))
def q_confusion(spark, sf):
    return ev.confusion(_scored(spark, sf))


CTE["counts"] = counts_sql("scored")


@query("classification_report", "E3 E1", with_(["scored", "counts"], report_sql("counts")))
def q_classification_report(spark, sf):
    return ev.classification_report(_scored(spark, sf))


@query("accuracy_argmax_vs_threshold", "E2 L5 L6", with_(["scored"], """
select avg(cast(label = pred as double)) as accuracy_argmax,
  avg(cast(label = cast(prob >= 0.5::double as integer) as double)) as accuracy_threshold,
  cast(count_if(pred <> cast(prob >= 0.5::double as integer)) as bigint) as n_disagree
from scored"""))
def q_accuracy_modes(spark, sf):
    from markspark.operators.label import predict_argmax, predict_threshold
    s = _scored(spark, sf).withColumn("pred_arg", predict_argmax()).withColumn("pred_th", predict_threshold("prob", 0.5))
    return s.agg(F.avg((F.col("label") == F.col("pred_arg")).cast("double")).alias("accuracy_argmax"),
                 F.avg((F.col("label") == F.col("pred_th")).cast("double")).alias("accuracy_threshold"),
                 F.count_if(F.col("pred_arg") != F.col("pred_th")).alias("n_disagree"))


CTE["roc"] = roc_sql("scored")


@query("roc_points", "E4", with_(["scored", "roc"], """
select score as threshold, cum_neg::double / tot_neg as fpr, cum_pos::double / tot_pos as tpr from roc
union all select null::double, 0.0::double, 0.0::double"""))
def q_roc_points(spark, sf):
    return ev.roc_curve(_scored(spark, sf))


@query("roc_auc", "E5", with_(["scored", "roc"], """
select sum(pos * (tot_neg - cum_neg + neg / 2.0::double)) / (max(tot_pos) * max(tot_neg)) as auc from roc"""))
def q_roc_auc(spark, sf):
    return ev.auc(_scored(spark, sf))


CTE["youden"] = """
select score as threshold, cum_pos::double / tot_pos - cum_neg::double / tot_neg as youden_j from roc
order by youden_j desc, threshold desc limit 1"""


@query("youden", "E6", with_(["scored", "roc", "youden"], "select * from youden"))
def q_youden(spark, sf):
    return ev.youden_threshold(_scored(spark, sf))


CTE["scored_yt"] = """
select s.*, cast(s.prob >= y.threshold as integer) as pred_th, y.threshold from scored s, youden y"""
CTE["counts_yt"] = counts_sql("scored_yt", pred="pred_th")


@query("report_at_youden", "E7 E6", with_(["scored", "roc", "youden", "scored_yt", "counts_yt"], f"""
select r.*, (select threshold from youden) as threshold from ({report_sql('counts_yt')}) r"""))
def q_report_at_youden(spark, sf):
    return ev.report_at_youden(_scored(spark, sf))


def _bin_sql(col: str, bins: int) -> str:
    return " + ".join(f"cast({col} > {dbl(i * (1.0 / bins))} as integer)" for i in range(1, bins))


@query("calibration_bins", "E8", with_(["scored"], f"""
select bin, {r9('avg(prob)')} as mean_prob, {r9('avg(label::double)')} as frac_pos, count(*) as n
from (select *, {_bin_sql('prob', 10)} as bin from scored) b group by bin"""))
def q_calibration_bins(spark, sf):
    c = ev.calibration_curve(_scored(spark, sf))
    return c.select("bin", sr9(F.col("mean_prob")).alias("mean_prob"), sr9(F.col("frac_pos")).alias("frac_pos"), "n")


def _hist_sql(src: str, col: str, bins: int) -> str:
    return f"""
select bin, lo + bin * ((hi - lo) / {bins}.0::double) as lo, lo + (bin + 1) * ((hi - lo) / {bins}.0::double) as hi,
  count(*) as n, count(*) / max(total)::double as share
from (select cast(least(floor(({col}::double - lo) * {bins}.0::double / (hi - lo)), {bins - 1}) as integer) as bin, lo, hi, total
      from {src}, (select min({col})::double as lo, max({col})::double as hi, count({col}) as total from {src}) mm
      where {col} is not null) b
group by bin, lo, hi"""


@query("prob_histogram", "W5", with_(["scored"], _hist_sql("scored", "prob", 10)))
def q_prob_histogram(spark, sf):
    return histogram(_scored(spark, sf), "prob", bins=10, normalize=True)


_THS = ev.arange(0.1, 1.0, 0.1)
_PT_SQL = " union all ".join(f"""
select {dbl(t)} as threshold,
  coalesce(count_if(prob < {dbl(t)} and label <> 1)::double / nullif(count_if(prob < {dbl(t)}), 0)::double, 0.0) as prec0,
  coalesce(count_if(prob >= {dbl(t)} and label = 1)::double / nullif(count_if(prob >= {dbl(t)}), 0)::double, 0.0) as prec1,
  cast(count(*) - count_if(label = 1) as bigint) as n0_actual, cast(count_if(label = 1) as bigint) as n1_actual,
  cast(count(*) - count_if(prob >= {dbl(t)}) as bigint) as n0_pred, cast(count_if(prob >= {dbl(t)}) as bigint) as n1_pred,
  count(*) as n_total from scored""" for t in _THS)


@query("precision_thresholds", "E9", with_(["scored"], _PT_SQL))
def q_precision_thresholds(spark, sf):
    return ev.precision_at_thresholds(_scored(spark, sf), _THS)


@query("decile_chart", "W2", with_(["scored"], f"""
select tile, n, n - n_1 as n_0, n_1, n - pred_1 as pred_0, pred_1,
  round_even((tp + tn) * 100.0::double / n, 2) as acc,
  round_even(tp * 100.0::double / nullif(tp + fp, 0), 2) as prec,
  round_even(tp * 100.0::double / nullif(tp + fn, 0), 2) as recall,
  round_even(2.0::double * round_even(tp * 100.0::double / nullif(tp + fp, 0), 2)
    * round_even(tp * 100.0::double / nullif(tp + fn, 0), 2)
    / nullif(round_even(tp * 100.0::double / nullif(tp + fp, 0), 2) + round_even(tp * 100.0::double / nullif(tp + fn, 0), 2), 0), 0) as f1
from (select cast(tile as integer) as tile, count(*) as n, cast(sum(label) as bigint) as n_1, cast(sum(pred) as bigint) as pred_1,
        count_if(label = 1 and pred = 1) as tp, count_if(label = 0 and pred = 0) as tn,
        count_if(label = 0 and pred = 1) as fp, count_if(label = 1 and pred = 0) as fn
      from (select *, ntile(10) over (order by prob desc, {SCORE_KEYS}, label, pred) as tile from scored) t group by tile) g"""))
def q_decile_chart(spark, sf):
    return order.decile_chart(_scored(spark, sf), 10, key=KEY + ["label", "pred"])


def _bce_sql(x: str) -> str:
    return f"(greatest({x}, 0.0::double) + ln(1.0::double + exp(-abs({x}))) - ({x}) * y)"


CTE["zt"] = """
select ln(prob / (1.0::double - prob)) as z, label::double as y from scored where prob > 0 and prob < 1"""


@query("temperature_grid", "E12 F12", with_(["scored", "zt"], " union all ".join(
    f"select {dbl(t)} as temperature, {r9('avg(' + _bce_sql(f'z / {dbl(t)}') + ')')} as loss from zt"
    for t in TEMP_GRID)))
def q_temperature_grid(spark, sf):
    g = cal.temperature_grid(_scored(spark, sf), TEMP_GRID)
    return g.select("temperature", sr9(F.col("loss")).alias("loss"))


@query("temperature_scaled_report", "E11 F13 E8", with_(["scored"], f"""
select bin, {r9('avg(prob_t)')} as mean_prob, {r9('avg(label::double)')} as frac_pos, count(*) as n
from (select *, {_bin_sql('prob_t', 10)} as bin from (
  select *, 1.0::double / (1.0::double + exp(-logit_1 / {dbl(FIXED_T)})) as prob_t from scored) s) b group by bin"""))
def q_temperature_scaled_report(spark, sf):
    s = cal.apply_temperature(_scored(spark, sf), FIXED_T)
    c = ev.calibration_curve(s, "prob_t")
    return c.select("bin", sr9(F.col("mean_prob")).alias("mean_prob"), sr9(F.col("frac_pos")).alias("frac_pos"), "n")


@query("temperature_fit", "E10")
def q_temperature_fit(spark, sf):
    return cal.fit_temperature_df(_scored(spark, sf))


CTE["boot_ix"] = f"""
select label, prob, pred, row_number() over (order by {SCORE_KEYS}, prob, label, pred) - 1 as idx from scored"""
CTE["boot_draws"] = f"""
select r.round, (('0x' || substr(md5(concat_ws('|', '{BOOT_SEED}', cast(r.round as varchar), cast(k.idx as varchar))), 1, 15))::bigint
    % (select count(*) from scored)) as idx
from (select unnest(range({BOOT_ROUNDS})) as round) r, boot_ix k"""
CTE["boot_rows"] = "select d.round, b.label, b.prob, b.pred from boot_draws d join boot_ix b on d.idx = b.idx"
CTE["boot_counts"] = counts_sql("boot_rows", by=["round"])
CTE["boot_roc"] = roc_sql("boot_rows", by=["round"])
CTE["boot_report"] = report_sql("boot_counts", ["round"])
CTE["boot_results"] = """
select a.round, a.f1 as accuracy, u.auc, w.precision, w.recall, w.f1
from (select * from boot_report where class_name = 'accuracy') a
join (select round, sum(pos * (tot_neg - cum_neg + neg / 2.0::double)) / (max(tot_pos) * max(tot_neg)) as auc
      from boot_roc group by round) u on a.round = u.round
join (select * from boot_report where class_name = 'weighted avg') w on a.round = w.round"""
BOOT_CHAIN = ["scored", "boot_ix", "boot_draws", "boot_rows", "boot_counts", "boot_roc", "boot_report", "boot_results"]


def _boot(spark, sf):
    return bs.bootstrap(_scored(spark, sf), KEY, rounds=BOOT_ROUNDS, seed=BOOT_SEED)


@query("bootstrap_rounds", "E14", with_(BOOT_CHAIN, f"""
select cast(round as integer) as round, {r9('accuracy')} as accuracy, {r9('auc')} as auc, {r9('precision')} as precision,
  {r9('recall')} as recall, {r9('f1')} as f1 from boot_results"""))
def q_bootstrap_rounds(spark, sf):
    b = _boot(spark, sf)
    return b.select(F.col("round").cast("int"), *[sr9(F.col(c)).alias(c) for c in ("accuracy", "auc", "precision", "recall", "f1")])


_QS = [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]
_SUM_SQL = " union all ".join(f"""
select '{m}' as metric, count({m}) as n, {r9(f'avg({m})')} as mean, {r9(f'stddev_samp({m})')} as std,
  {r9(f'avg({m}) - 1.96::double * stddev_samp({m}) / sqrt(count({m}))')} as ci_lo,
  {r9(f'avg({m}) + 1.96::double * stddev_samp({m}) / sqrt(count({m}))')} as ci_hi,
  {", ".join(f"{r9(f'quantile_cont({m}, {dbl(q)})')} as q{i}" for i, q in enumerate(_QS))}
from boot_results""" for m in ("accuracy", "auc", "precision", "recall", "f1"))


@query("bootstrap_summary", "E15 A12 A13 A14", with_(BOOT_CHAIN, _SUM_SQL))
def q_bootstrap_summary(spark, sf):
    s = bs.bootstrap_summary(_boot(spark, sf), qs=_QS)
    cols = ["mean", "std", "ci_lo", "ci_hi"] + [f"q{i}" for i in range(len(_QS))]
    return s.select("metric", "n", *[sr9(F.col(c)).alias(c) for c in cols])


@query("oov_report", "E17 P13", with_(["scored"], "select * from (" + report_sql(
    "(" + counts_sql("(select * from scored where l_returnflag = 'N')") + ")") + ")"))
def q_oov_report(spark, sf):
    return ev.classification_report(_scored(spark, sf).filter(F.col("l_returnflag") == "N"))


@query("prediction_table", "E19 J10", with_(["scored"], f"""
select s.l_orderkey, s.l_partkey, s.l_suppkey, s.l_linenumber, s.label, s.pred,
  round_even(s.prob, 4) as prob, cast(o.o_orderdate as date) as filing_dt
from scored s join orders o on s.l_orderkey = o.o_orderkey"""))
def q_prediction_table(spark, sf):
    s = _scored(spark, sf).select(*KEY, "label", "pred", round_even(F.col("prob"), 4).alias("prob"))
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("filing_dt"))
    return s.join(o, "l_orderkey")


@query("row_filters", "P13 P14", with_(["scored"], f"""
select {SCORE_KEYS}, prob from scored where prob > 0.5::double and prob < 0.6::double and label = pred"""))
def q_row_filters(spark, sf):
    from markspark.operators.clean import correct_only, row_filter
    s = correct_only(_scored(spark, sf))
    return row_filter(s, (F.col("prob") > F.lit(0.5)) & (F.col("prob") < F.lit(0.6))).select(*KEY, "prob")


def _full_report(spark, sf):
    s = _scored(spark, sf)
    parts = []
    conf = ev.confusion(s)
    parts.append(conf.select(F.lit("confusion").alias("section"),
                             F.concat(F.lit("label="), F.col("label").cast("string"), F.lit(",pred="),
                                      F.col("pred").cast("string")).alias("name"), F.col("n").cast("double").alias("value")))
    parts.append(ev.auc(s).select(F.lit("auc").alias("section"), F.lit("auc").alias("name"), F.col("auc").alias("value")))
    rep = ev.classification_report(s)
    for m in ("precision", "recall", "f1"):
        parts.append(rep.filter(F.col(m).isNotNull()).select(
            F.lit("report").alias("section"), F.concat(F.col("class_name"), F.lit(":" + m)).alias("name"), F.col(m).alias("value")))
    cb = ev.calibration_curve(s)
    parts.append(cb.select(F.lit("calibration").alias("section"),
                           F.concat(F.lit("bin"), F.col("bin").cast("string"), F.lit(":frac_pos")).alias("name"),
                           F.col("frac_pos").alias("value")))
    dc = order.decile_chart(s, 10, key=KEY + ["label", "pred"])
    parts.append(dc.select(F.lit("decile").alias("section"),
                           F.concat(F.lit("tile"), F.col("tile").cast("string"), F.lit(":acc")).alias("name"),
                           F.col("acc").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("section", "name", sr9(F.col("value")).alias("value"))


@query("full_report", "E13", with_(["scored", "roc", "counts"], f"""
select section, name, {r9('value')} as value from (
  select 'confusion' as section, 'label=' || label || ',pred=' || pred as name, count(*)::double as value
  from scored group by label, pred
  union all
  select 'auc', 'auc', sum(pos * (tot_neg - cum_neg + neg / 2.0::double)) / (max(tot_pos) * max(tot_neg)) from roc
  union all
  select 'report', class_name || ':precision', precision from ({report_sql('counts')}) r where precision is not null
  union all
  select 'report', class_name || ':recall', recall from ({report_sql('counts')}) r where recall is not null
  union all
  select 'report', class_name || ':f1', f1 from ({report_sql('counts')}) r
  union all
  select 'calibration', 'bin' || bin || ':frac_pos', avg(label::double)
  from (select *, {_bin_sql('prob', 10)} as bin from scored) b group by bin
  union all
  select 'decile', 'tile' || tile || ':acc', round_even(count_if(label = pred) * 100.0::double / count(*), 2)
  from (select *, ntile(10) over (order by prob desc, {SCORE_KEYS}, label, pred) as tile from scored) t group by tile) u"""))
def q_full_report(spark, sf):
    return _full_report(spark, sf)


_DESC = ["prob", "logit_1"]
_QS_A13 = [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]


@query("describe_scores", "A12", with_(["scored"], " union all ".join(f"""
select '{c}' as metric, count({c}) as count, {r9(f'avg({c})')} as mean, {r9(f'stddev_samp({c})')} as std,
  min({c})::double as min, {r9(f'quantile_cont({c}, 0.25::double)')} as p25, {r9(f'quantile_cont({c}, 0.5::double)')} as p50,
  {r9(f'quantile_cont({c}, 0.75::double)')} as p75, max({c})::double as max from scored""" for c in _DESC)))
def q_describe_scores(spark, sf):
    from markspark.operators.stats import describe
    d = describe(_scored(spark, sf), _DESC)
    return d.select("metric", "count", sr9(F.col("mean")).alias("mean"), sr9(F.col("std")).alias("std"), "min",
                    sr9(F.col("p25")).alias("p25"), sr9(F.col("p50")).alias("p50"), sr9(F.col("p75")).alias("p75"), "max")


@query("quantile_table", "A13", with_(["scored"], " union all ".join(
    f"select '{c}' as metric, {dbl(q)} as q, round_even(round_even(quantile_cont({c}, {dbl(q)}), 12), 4) as value from scored"
    for c in _DESC for q in _QS_A13)))
def q_quantile_table(spark, sf):
    from markspark.operators.stats import quantiles
    from markspark.functions.numeric import round_even as re_
    q = quantiles(_scored(spark, sf), _DESC, _QS_A13, digits=None)
    return q.select("metric", "q", re_(re_(F.col("value"), 12), 4).alias("value"))


def _poisson_sql() -> str:
    from markspark.operators.bootstrap import poisson1_cdf
    keys = ", ".join(f"cast({k} as varchar)" for k in KEY)
    u = (f"(('0x' || substr(md5(concat_ws('|', '{BOOT_SEED}', cast(r.round as varchar), {keys})), 1, 15))::bigint"
         f"::double / 1152921504606846976.0::double)")
    cases = " ".join(f"when {u} < {dbl(c)} then {k}" for k, c in enumerate(poisson1_cdf()))
    return f"select r.round, s.label, s.prob, s.pred, case {cases} else 16 end as w " \
           f"from scored s, (select unnest(range({BOOT_ROUNDS})) as round) r"


CTE["pw"] = "select * from (" + _poisson_sql() + ") x where w > 0"
CTE["pw_counts"] = """
select round, sum(case when label = 1 and pred = 1 then w else 0 end) as tp,
  sum(case when label = 0 and pred = 0 then w else 0 end) as tn, sum(case when label = 0 and pred = 1 then w else 0 end) as fp,
  sum(case when label = 1 and pred = 0 then w else 0 end) as fn, sum(w) as n from pw group by round"""
CTE["pw_roc"] = """
select *, sum(pos) over (partition by round order by score desc rows between unbounded preceding and current row) as cum_pos,
  sum(neg) over (partition by round order by score desc rows between unbounded preceding and current row) as cum_neg,
  sum(pos) over (partition by round) as tot_pos, sum(neg) over (partition by round) as tot_neg
from (select round, prob as score, sum(case when label = 1 then w else 0 end) as pos,
        sum(case when label <> 1 then w else 0 end) as neg from pw group by round, prob) st"""
CTE["pw_report"] = report_sql("pw_counts", ["round"])


@query("bootstrap_poisson", "E14 (Poisson weights)", with_(["scored", "pw", "pw_counts", "pw_roc", "pw_report"], f"""
select cast(a.round as integer) as round, {r9('a.f1')} as accuracy, {r9('u.auc')} as auc, {r9('w.precision')} as precision,
  {r9('w.recall')} as recall, {r9('w.f1')} as f1
from (select * from pw_report where class_name = 'accuracy') a
join (select round, sum(pos * (tot_neg - cum_neg + neg / 2.0::double)) / (max(tot_pos) * max(tot_neg)) as auc
      from pw_roc group by round) u on a.round = u.round
join (select * from pw_report where class_name = 'weighted avg') w on a.round = w.round"""))
def q_bootstrap_poisson(spark, sf):
    b = bs.bootstrap(_scored(spark, sf), KEY, rounds=BOOT_ROUNDS, seed=BOOT_SEED, method="poisson")
    return b.select(F.col("round").cast("int"), *[sr9(F.col(c)).alias(c) for c in ("accuracy", "auc", "precision", "recall", "f1")])


def _split_boot(spark, sf):
    return resample.split_bootstrap(_scored(spark, sf), rounds=BOOT_ROUNDS, seed=BOOT_SEED)


@query("bootstrap_split", "E14 (multinomial splitting)")
def q_bootstrap_split(spark, sf):
    return _split_boot(spark, sf)


# what must hold of any such draws: n rows a round, no round far from the table's own figures (6 standard errors)
@query("bootstrap_split_check", "E14 Q1", with_(["scored"], f"""
select cast({BOOT_ROUNDS} as bigint) as rounds, n as least_drawn, n as most_drawn, cast({BOOT_ROUNDS} as bigint) as rounds_in_band
from (select count(*) as n from scored) t"""))
def q_bootstrap_split_check(spark, sf):
    whole = _scored(spark, sf).agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("p"), F.count(F.lit(1)).alias("rows"))
    band = 6 * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("rows"))
    boot = _split_boot(spark, sf).join(F.broadcast(whole), F.col("rows") == F.col("n"))  # one row
    return boot.agg(F.count(F.lit(1)).alias("rounds"), F.min("n").alias("least_drawn"), F.max("n").alias("most_drawn"),
                    F.count_if(F.abs(F.col("accuracy") - F.col("p")) <= band).alias("rounds_in_band"))
