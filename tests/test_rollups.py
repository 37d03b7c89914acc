"""Reports made of stored partials and of rows at the cut edges of a range."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from telemill.operators import api, events, tools, usage
from telemill.plans import fixture
from telemill.sources import compaction, rollups, tables
from tests.helpers import at, logs, tool_result

SF = "/root/testdata/sf0.001"
LAST = date(2024, 1, 30)
RANGES = [None, datetime(2024, 1, 10), datetime(2024, 1, 20, 7, 31, 5, 123), datetime(2024, 1, 30, 12), datetime(2025, 1, 1)]


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("rollups"))
    base = fixture.base_events(spark, SF)
    for part in range(2):
        some = base.where(F.col("id") % 2 == part)
        tables.append_tables({name: build(some) for name, build in fixture.TABLES.items()}, root, f"part-{part}")
    rollups.build_rollups(spark, root, LAST)
    return root


def rounded(frame):
    columns = [F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in frame.schema]
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def read(spark, root, *names):
    return [tables.read(spark, root, name) for name in names]


@pytest.mark.parametrize("since", RANGES)
def test_reports_equal_those_of_the_rows(spark, root, since):
    logs_, legacy, tokens, costs, sessions = read(
        spark, root, "log_events", "tool_events", "token_usage", "cost_usage", "session_metrics"
    )
    calls = events.unified_tool_events(legacy, logs_, since)
    assert rounded(rollups.tool_metrics(spark, root, since)) == rounded(tools.tool_metrics(calls))
    assert rounded(rollups.api_totals(spark, root, since)) == rounded(api.api_totals(logs_, since))
    assert rounded(rollups.api_by_model(spark, root, since)) == rounded(api.api_by_model(logs_, since))
    assert rounded(rollups.token_totals(spark, root, since)) == rounded(usage.token_totals(tokens, costs, since))
    assert rounded(rollups.session_metrics(spark, root, since)) == rounded(usage.session_metrics(sessions, since))


def files_read(spark, root, name, since):
    found = rollups.sources(spark, root, name, since)
    return found, {p.split("event_date=")[1][:10] for paths in found.rows.values() for p in paths}


def test_rows_are_read_for_cut_days_only(spark, root):
    found, days = files_read(spark, root, "tool_days", datetime(2024, 1, 20, 7, 31, 5))
    assert days == {"2024-01-20", "2024-01-30"} and len(found.rollup) == 9
    plan = rollups.tool_metrics(spark, root, datetime(2024, 1, 20, 7, 31, 5))
    opened = {f.split("table=")[1].split("/")[0] + f.split("event_date=")[1][:10] for f in plan.inputFiles()}
    assert {f for f in opened if not f.startswith("tool_days")} == {
        f"{name}{day}" for name in ("log_events", "tool_events") for day in ("2024-01-20", "2024-01-30")
    }
    assert files_read(spark, root, "tool_days", datetime(2024, 1, 20))[1] == {"2024-01-30"}


def test_rolling_up_again_finds_nothing(spark, root):
    assert rollups.build_rollups(spark, root, LAST) == []


def call(spark, tool, day, place):
    return logs(spark, (*tool_result(tool), day * 86400)).withColumn("id", F.lit(place).cast("bigint"))


def count(spark, root):
    return sum(r.call_count for r in rollups.tool_metrics(spark, root).collect())


def test_rows_that_come_after_a_rollup(spark, tmp_path):
    root, before = str(tmp_path), date(2024, 2, 1)
    for place in range(3):
        tables.append(call(spark, "t", place % 2, place), root, "log_events", f"l{place}")
    assert rollups.build_rollups(spark, root, before, ("tool_days",)) == ["2024-01-10", "2024-01-11"]
    tables.append(call(spark, "t", 0, 9), root, "log_events", "late")
    found, days = files_read(spark, root, "tool_days", None)
    assert days == {"2024-01-10"} and len(found.rollup) == 2 and len(found.rows["log_events"]) == 1
    assert count(spark, root) == 4
    # Packing moves rolled-up rows to a new folder; they still count once.
    compaction.compact(spark, root, before)
    assert count(spark, root) == 4
    compaction.clean(spark, root, grace_hours=-1)
    assert count(spark, root) == 4
    assert rollups.build_rollups(spark, root, before, ("tool_days",)) == ["2024-01-10"]
    found, days = files_read(spark, root, "tool_days", None)
    assert days == set() and len(found.rollup) == 2 and count(spark, root) == 4
    # A load that is run again takes the rollup of its day out of use.
    tables.append(call(spark, "u", 1, 1), root, "log_events", "l1")
    assert files_read(spark, root, "tool_days", None)[1] == {"2024-01-11"}
    assert {r.tool_name: r.call_count for r in rollups.tool_metrics(spark, root).collect()} == {"t": 3, "u": 1}
    tables.append(call(spark, "u", 5, 2), root, "log_events", "l2")
    assert {r.tool_name: r.call_count for r in rollups.tool_metrics(spark, root).collect()} == {"t": 2, "u": 2}
    assert rollups.build_rollups(spark, root, before, ("tool_days",)) != []
    assert {r.tool_name: r.call_count for r in rollups.tool_metrics(spark, root).collect()} == {"t": 2, "u": 2}


def test_packed_days_keep_their_rollup(spark, tmp_path):
    root, before = str(tmp_path), date(2024, 2, 1)
    for place in range(3):
        tables.append(call(spark, "t", 0, place), root, "log_events", f"l{place}")
    rollups.build_rollups(spark, root, before)
    compaction.compact(spark, root, before)
    found, days = files_read(spark, root, "tool_days", None)
    assert days == set() and len(found.rollup) == 1
    assert rollups.build_rollups(spark, root, before) == [] and count(spark, root) == 3


def test_a_moment_of_another_zone(spark, root):
    east = timezone(timedelta(hours=9))
    local = datetime(2024, 1, 20, 9, tzinfo=east)  # midnight in UTC
    assert files_read(spark, root, "tool_days", local)[1] == {"2024-01-30"}
    same = datetime(2024, 1, 20)
    assert rounded(rollups.tool_metrics(spark, root, local)) == rounded(rollups.tool_metrics(spark, root, same))


def test_without_rows(spark, tmp_path):
    root = str(tmp_path / "none")
    assert rollups.build_rollups(spark, root, LAST) == []
    assert rollups.tool_metrics(spark, root).count() == 0
    assert rollups.api_totals(spark, root).first().total_calls == 0
    assert rollups.token_totals(spark, root, at(0)).first().total_tokens == 0
