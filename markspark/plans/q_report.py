"""The full report with its sink (E13) and guarded lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from markspark.operators import evaluate as ev
from markspark.operators import guards, report
from markspark.plans import adapters as ad
from markspark.plans.oracle import with_
from markspark.plans.q_eval import _bin_sql, _hist_sql, _PT_SQL
from markspark.plans.q_io import scratch
from markspark.plans.registry import query
from markspark.plans.sqlkit import r9, report_sql, sr9
from markspark.sources.tables import load

_CLASS_PARTS = ("precision", "recall", "f1", "support")
_TH_PARTS = ("prec0", "prec1", "n0_actual", "n1_actual", "n0_pred", "n1_pred", "n_total")
_TILE_PARTS = ("n", "n_0", "n_1", "pred_0", "pred_1", "acc", "prec", "recall", "f1")


def _stack(src: str, section: str, name: str, parts) -> str:
    return " union all ".join(f"select '{section}' as section, {name} || ':{p}' as name, ({p})::double as value from ({src}) x_{p}"
                              for p in parts)


_TILES = """
select tile, n, n - n_1 as n_0, n_1, n - pred_1 as pred_0, pred_1, round_even((tp + tn) * 100.0::double / n, 2) as acc,
  round_even(tp * 100.0::double / nullif(pred_1, 0), 2) as prec, round_even(tp * 100.0::double / nullif(n_1, 0), 2) as recall,
  round_even(2.0::double * round_even(tp * 100.0::double / nullif(pred_1, 0), 2) * round_even(tp * 100.0::double / nullif(n_1, 0), 2)
    / nullif(round_even(tp * 100.0::double / nullif(pred_1, 0), 2) + round_even(tp * 100.0::double / nullif(n_1, 0), 2), 0), 0) as f1
from (select tile, count(*) as n, sum(label) as n_1, sum(pred) as pred_1, count_if(label = 1 and pred = 1) as tp,
        count_if(label = 0 and pred = 0) as tn
      from (select *, ntile(10) over (order by prob desc, label, pred) as tile from scored) t group by tile) g"""


@query("report_bundle", "E13 E1 E3 E4 E5 E8 E9 W2 W5 S6", with_(["scored", "roc", "counts"], f"""
select section, name, {r9('value')} as value from (
  {_stack("select label, pred, count(*) as n, count(*) / sum(count(*)) over () as share from scored group by label, pred", "confusion",
          "'label=' || label || ',pred=' || pred", ("n", "share"))}
  union all {_stack(report_sql('counts'), "classes", "class_name", _CLASS_PARTS)}
  union all select 'auc', 'auc', sum(pos * (tot_neg - cum_neg + neg / 2.0::double)) / (max(tot_pos) * max(tot_neg)) from roc
  union all select 'roc', 'points', (count(*) + 1)::double from roc
  union all select 'roc', 'area', sum(cum_neg::double / tot_neg) + sum(cum_pos::double / tot_pos) from roc
  union all {_stack(f"select bin, avg(prob) as mean_prob, avg(label::double) as frac_pos, count(*) as n from (select *, "
                    f"{_bin_sql('prob', 10)} as bin from scored) b group by bin", "calibration", "'bin' || bin", ("mean_prob", "frac_pos", "n"))}
  union all {_stack(_hist_sql("scored", "prob", 10), "histogram", "'bin' || bin", ("n", "share"))}
  union all {_stack(f"select *, cast(round(threshold * 10) as integer) as i from ({_PT_SQL}) pt", "precision", "'th' || i", _TH_PARTS)}
  union all {_stack(_TILES, "deciles", "'tile' || tile", _TILE_PARTS)}) u where value is not null"""))
def q_report_bundle(spark, sf):
    path = scratch(spark, "report")
    report.publish(report.sections(report.score_cube(ad.scored(spark, sf))), path)
    s = report.read_published(spark, path)

    def long(part, section, name, cols):
        each = F.array(*[F.struct(F.concat(name, F.lit(f":{c}")).alias("name"), F.col(c).cast("double").alias("value")) for c in cols])
        return part.select(F.lit(section).alias("section"), F.explode(each).alias("_x")).select("section", "_x.*")

    text = lambda c: F.col(c).cast("string")
    parts = [
        long(s["confusion"], "confusion", F.concat(F.lit("label="), text("label"), F.lit(",pred="), text("pred")), ("n", "share")),
        long(s["classes"], "classes", F.col("class_name"), _CLASS_PARTS),
        s["auc"].select(F.lit("auc").alias("section"), F.lit("auc").alias("name"), F.col("auc").alias("value")),
        s["roc"].select(F.lit("roc").alias("section"), F.lit("points").alias("name"), F.lit(1.0).alias("value")).groupBy("section", "name").agg(
            F.sum("value").alias("value")),
        s["roc"].groupBy(F.lit("roc").alias("section"), F.lit("area").alias("name")).agg((F.sum("fpr") + F.sum("tpr")).alias("value")),
        long(s["calibration"], "calibration", F.concat(F.lit("bin"), text("bin")), ("mean_prob", "frac_pos", "n")),
        long(s["histogram"], "histogram", F.concat(F.lit("bin"), text("bin")), ("n", "share")),
        long(s["precision"], "precision", F.concat(F.lit("th"), F.round(F.col("threshold") * 10).cast("int").cast("string")), _TH_PARTS),
        long(s["deciles"], "deciles", F.concat(F.lit("tile"), text("tile")), _TILE_PARTS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("value is not null").select("section", "name", sr9(F.col("value")).alias("value"))


# a unique lookup is published, one with repeated keys is not, nor one whose row count is not the expected one
@query("guarded_lookups", "Q1 Q2 J3 J5", """
select 'customer' as lookup, count(*) as rows_in, count(*) as rows_out, count(c.c_custkey) as matched, true as published
from orders o left join customer c on o.o_custkey = c.c_custkey
union all
select 'lineitem', (select count(*) from orders), count(*), count(l.l_orderkey),
  count(*) = (select count(*) from orders) from orders o left join lineitem l on o.o_orderkey = l.l_orderkey
union all
select 'expected', count(*), count(*), count(c.c_custkey), false from orders o left join customer c on o.o_custkey = c.c_custkey""")
def q_guarded_lookups(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customers = load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    lines = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    rows = []
    for name, lookup, on, expect in (("customer", customers, ["o_custkey"], None), ("lineitem", lines, ["o_orderkey"], None),
                                     ("expected", customers, ["o_custkey"], -1)):
        path = scratch(spark, f"guard-{name}")
        guard = guards.guarded_lookup(orders, lookup, on, path, expect_n=expect, raise_on_fail=False)
        try:
            shown = report.read_published(spark, path)["rows"].count() == guard.rows_out
        except Exception as e:  # noqa: BLE001 - no commit marker: the path does not exist
            if "PATH_NOT_FOUND" not in str(e):
                raise
            shown = False
        rows.append((name, guard.rows_in, guard.rows_out, guard.matched, shown))
    return spark.createDataFrame(rows, "lookup string, rows_in long, rows_out long, matched long, published boolean")


# out-of-lexicon marks: the report on the rows without a lexicon word, both classes
@query("oov_marks_report", "E17 J11 P13", with_(["court"], f"""
select * from ({report_sql('''(select cast(count_if(distinct_ind = 1 and model_preds = 1) as bigint) as tp,
  cast(count_if(distinct_ind = 0 and model_preds = 0) as bigint) as tn, cast(count_if(distinct_ind = 0 and model_preds = 1) as bigint) as fp,
  cast(count_if(distinct_ind = 1 and model_preds = 0) as bigint) as fn, count(*) as n from court where not exists (
    select 1 from (select unnest(regexp_split_to_array(lower(mark), '\\s+')) as token) t
    where t.token in (select w from (select distinct unnest(string_split(lower(p_name), ' ')) as w from part) v
                      where substr(md5(w), 1, 1) < '6')))''')}) r"""))
def q_oov_marks_report(spark, sf):
    from markspark.operators.joins import lexicon_indicator
    words = load(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("token")).distinct()
    words = words.filter(F.substring(F.md5("token"), 1, 1) < "6")  # the stand-in lexicon: some of the words
    marks = lexicon_indicator(ad.court_decisions(spark, sf), "row_id", "mark", words)
    return ev.classification_report(marks.filter("wn_ind = 0"), "distinct_ind", "model_preds")
