"""What the plans must look like when nothing is small enough to broadcast."""

from __future__ import annotations

import pytest

from veridraft.plans.registry import all_queries
from veridraft.sources.adapters import Views
from veridraft.operators import decisions, scoring, triage

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_no_plan_compares_everything_with_everything(spark, no_broadcast):
    for name, query in all_queries().items():
        text = plan(query.run(spark, FOLDER))
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text, name


def test_rescore_reads_four_columns_and_combines_early(spark, no_broadcast):
    v = Views(spark, FOLDER)
    text = plan(scoring.active_totals(v.flags()))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string,l_linestatus:string>" in text
    assert text.count("Exchange") == 1 and "partial_sum" in text


def test_dashboard_is_one_aggregation(spark):
    text = plan(triage.dashboard(Views(spark, FOLDER).audits()))
    assert text.count("HashAggregate") == 2


def test_filters_reach_the_scan(spark):
    urgent = Views(spark, FOLDER).table("orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan(urgent)


def test_ordered_groups_force_no_broadcast(spark, no_broadcast):
    """The list of large groups grows with the data: its join is left to the planner."""
    for name in ("b01_waterfall_large_audits", "a64_history_large_flags", "b02_progression_large_audits"):
        assert "BroadcastHashJoin" not in plan(all_queries()[name].run(spark, FOLDER)), name


def test_submitted_decisions_meet_flags_as_a_small_side(spark):
    """A65 leaves no distinct over all flags: they are filtered by the pairs of the batch first."""
    v = Views(spark, FOLDER)
    _ok, rejected = decisions.split_decisions(v.decisions().limit(5), v.decision_audits(), v.decision_flags())
    assert "LeftSemi" in plan(rejected)


def test_recent_audits_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in plan(triage.recent_audits(Views(spark, FOLDER).audits()))
