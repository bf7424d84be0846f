"""Registered queries: a sample against SQL here, all of them with tests/oracle_check.py."""

import pytest
from oracle_check import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

PATH = "/root/testdata/sf0.001"
SAMPLE = ["eval_priors", "interpolate_linear", "rolling_centered", "curve_interp", "interval_context", "score_report", "contract_guard", "blend_bins_shrunk", "plane_predict", "ridge_oof", "gated_transfer", "st_gap_monitor"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    assert compare(queries()[name](spark, PATH), connect(PATH), oracle_sql()[name]).startswith("ok")


def test_entry_has_rows(spark):
    assert entry(spark).count() == 2


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_nested_loops(spark):
    for name in ("curve_interp", "knn_exclude_self", "boundary_counts", "cross_grid_join", "candidate_signatures"):
        plan = plan_of(queries()[name](spark, PATH))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_all_windows_share_one_exchange(spark):
    from loomlog.bindings import seq_log
    from loomlog.operators.sequence import rolling_centered

    plan = plan_of(rolling_centered(seq_log(spark, PATH), "gr", stats=("mean", "std", "min", "max")))
    assert plan.count("Exchange") == 1


def test_scan_reads_only_needed_columns(spark):
    plan = plan_of(queries()["project_read"](spark, PATH))
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string,l_shipdate" in plan and "PushedFilters: [IsNotNull(l_shipdate)" in plan
