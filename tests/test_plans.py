"""Plan checks: no Python evaluation, nested-loop or cartesian joins in the
relational queries, and the data-sized sorts are range-partitioned."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")

BAD = ["BatchEvalPython", "ArrowEvalPython", "BroadcastNestedLoopJoin", "CartesianProduct"]
# model training/scoring queries run Spark ML; the user-model hook is the only Python path
MODEL = {"gbt_scores", "split_importance", "text_classifier_scores", "ablation_report", "occlusion", "temperature_fit"}


def _names():
    import __spark_entry__ as E
    return sorted(set(E.queries()) - MODEL)


@pytest.mark.parametrize("name", _names())
def test_relational_plan(spark, name):
    import __spark_entry__ as E
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [b for b in BAD if b in plan]


def test_decile_sort_is_range_partitioned(spark):
    import __spark_entry__ as E
    from markspark.operators import order
    from markspark.plans import adapters as ad
    s = ad.scored(spark, SF)
    sorted_plan = s.orderBy("prob")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in sorted_plan.lower()
    dc = order.decile_chart(s, 10, key=ad.SCORE_KEY + ["label", "pred"])
    assert dc.count() == 10
