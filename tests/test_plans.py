"""Structural guards on the physical plans of the registered queries.

No cross products or nested-loop joins, no exchange into a single partition
(a global window or sort), and pruned parquet scans.
"""

import re

import pytest

import __spark_entry__ as se

SF = "/root/testdata/sf0.001"
# these fit models or run decomposition searches while the query is
# constructed; their final plans are simple scans over checkpointed tables
EAGER = {"fit_boosted_multistep", "evaluate_splits", "feature_importance", "booster_search", "stability_runs",
         "fit_sequence_regressor", "feature_importance_top", "joint_boosted_multistep", "epsilon_grid_search", "alpha_search"}
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition")


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in se.queries() if n not in EAGER))
def test_plan_has_no_global_operators(spark, name):
    plan = physical(se.queries()[name](spark, SF))
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad} in plan"


def test_event_scans_are_pruned(spark):
    plan = physical(se.queries()["persistence_metrics"](spark, SF))
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", spark._jvm.PythonSQLUtils.explainString(
        se.queries()["persistence_metrics"](spark, SF)._jdf.queryExecution(), "formatted")))
    assert schemas and all("props" not in s and "user_id" not in s for s in schemas)
    assert "Window" in plan
