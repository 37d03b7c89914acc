"""What the plans look like, since that is what counts on large tables."""

from __future__ import annotations

import pytest

from telemill.plans.registry import BATCH, INGEST, Telemetry

SF = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [*BATCH, *INGEST])
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(BATCH.get(name, INGEST.get(name))(Telemetry(spark, SF)))
    for unwanted in ("Python", "Cartesian", "NestedLoop"):
        assert unwanted not in plan


def test_time_range_reaches_the_scan(spark):
    plan = plan_of(BATCH["tool_metrics_last_week"](Telemetry(spark, SF)))
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert len(scans) == 2
    assert all("GreaterThanOrEqual(ts" in scan for scan in scans)


def test_columns_are_pruned(spark):
    plan = plan_of(BATCH["tokens_by_type"](Telemetry(spark, SF)))
    assert "ReadSchema: struct<value:double,props:string>" in plan
    assert "map(" not in plan_of(BATCH["tool_metrics_legacy_union"](Telemetry(spark, SF)))


def test_calls_are_aggregated_before_the_only_shuffle(spark):
    plan = plan_of(BATCH["tool_metrics_legacy_union"](Telemetry(spark, SF)))
    assert plan.count("Exchange") == 1
    assert plan.index("functions=[count") < plan.index("Exchange") < plan.index("partial_count")


def test_dimensions_join_after_the_aggregation(spark):
    plan = plan_of(BATCH["tool_agents"](Telemetry(spark, SF)))
    assert plan.count("hashpartitioning") == 1
    assert plan.index("BroadcastHashJoin") < plan.index("hashpartitioning")
    assert "LocalTableScan" in plan


@pytest.mark.parametrize("name", ["last_error_all", "tool_detail"])
def test_last_errors_sort_no_errors(spark, name):
    plan = plan_of(BATCH[name](Telemetry(spark, SF)))
    assert "SortAggregate" not in plan
    # The errors meet the newest times by broadcast, and are ranked a few a task.
    assert "BroadcastHashJoin" in plan and "WindowGroupLimit" in plan
    assert plan.count("SortMergeJoin") == (name == "tool_detail")  # with the report, a row per tool
