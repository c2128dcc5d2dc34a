import re

import pytest

import __spark_entry__ as E
from tools.plan_audit import audit

SF = "/root/testdata/sf0.001"
NO_TRAINING = ["scan_players", "roas_trend", "rfm_summary", "channel_rfm", "ltv_pct_rank", "holdout_split",
               "budget_allocation", "mc_bands", "customer_clv", "channel_clv", "classification_metrics",
               "engagement_score", "txn_profile", "channel_mix", "label_balance", "retention_curve"]


def _plan(spark, name):
    df = E.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NO_TRAINING)
def test_no_python_no_cartesian(spark, name):
    a = audit(_plan(spark, name))
    assert a["python"] == 0 and a["nlj_cartesian"] == 0, a


def test_observation_window_is_pushed_into_scan(spark):
    plan = _plan(spark, "rfm_summary")
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(o_orderdate", plan)
    assert "o_orderpriority" not in re.search(r"ReadSchema: struct<[^>]*>", plan).group(0)


def test_projection_prunes_scan(spark):
    plan = _plan(spark, "feature_projection")
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert all("c_name" not in s and "o_orderpriority" not in s for s in schemas), schemas


def test_single_partition_exchanges_only_after_aggregation(spark):
    """Un-partitioned windows / global aggregates may only see already-aggregated rows."""
    for name in ["channel_mix", "ltv_pct_rank", "roc_auc"]:
        plan = _plan(spark, name)
        for m in re.finditer(r"Exchange SinglePartition", plan):
            below = plan[m.end(): m.end() + 400]
            assert "HashAggregate" in below or "Window" in below or "Project" in below, below
