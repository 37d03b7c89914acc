from __future__ import annotations

from datetime import timedelta

import pytest

from telemill.functions.time_ranges import range_label, since_for
from telemill.operators import events, tools
from telemill.sources import tables
from telemill.sources.errors import search_last_error
from tests.helpers import START, at, by, legacy, logs, tool_result, utc


def report(spark, *rows, old=()):
    return tools.tool_metrics(
        events.unified_tool_events(legacy(spark, *old), logs(spark, *rows))
    )


def test_counts_durations_and_outcomes(spark):
    found = by(
        report(
            spark,
            tool_result("Read", "true", "50"),
            tool_result("Read", "true", "30"),
            tool_result("Write", "false", "100"),
            tool_result("Bash", "true", "200"),
        ),
        "tool_name",
    )
    assert set(found) == {"Read", "Write", "Bash"}
    read = found["Read"]
    assert (read.call_count, read.avg_duration_ms) == (2, 40.0)
    assert (read.min_duration_ms, read.max_duration_ms) == (30, 50)
    assert utc(read.last_call) == at(1)
    assert found["Write"].error_count == 1
    assert found["Bash"].success_count == 1


def test_event_names(spark):
    found = by(
        report(
            spark,
            tool_result("a", name="tool_result"),
            tool_result("a", name="claude_code.tool_result"),
            tool_result("a", name="toolXresult"),
            tool_result("a", name="TOOL_RESULT"),
            tool_result("a", name="tool_result_modified"),
            tool_result("a", name=None),
        ),
        "tool_name",
    )
    assert found["a"].call_count == 3


@pytest.mark.parametrize(
    "text, good",
    [("true", 1), ("1", 1), ("false", 0), ("TRUE", 0), ("yes", 0), ("0", 0), (None, 0)],
)
def test_success_texts(spark, text, good):
    row = report(spark, tool_result("t", text)).first()
    assert (row.success_count, row.error_count) == (good, 1 - good)


def test_missing_and_bad_values(spark):
    found = by(
        report(
            spark,
            ("tool_result", {}),
            tool_result("t", duration=None),
            *[tool_result("t", duration=text) for text in ("abc", "12.7", "", "1e3")],
            tool_result("t", duration=" 7 "),
        ),
        "tool_name",
    )
    assert found["unknown"].call_count == 1
    assert found["t"].call_count == 6
    assert found["t"].max_duration_ms == 7
    assert found["t"].bad_duration_count == 4


def test_decisions(spark):
    rows = [
        tool_result("t", decision=d)
        for d in ("approved", "auto_approved", "rejected", "asked", None)
    ]
    metrics = report(spark, *rows, old=[("t", True, 1, None)])
    row = tools.with_rates(metrics).first()
    assert (row.approved_count, row.rejected_count, row.call_count) == (2, 1, 6)
    assert row.approval_rate == pytest.approx(200 / 3)


def test_rates(spark):
    rows = [tool_result("t", decision="approved")] * 8 + [
        tool_result("t", "false", decision="rejected")
    ] * 2
    row = tools.with_rates(report(spark, *rows, tool_result("none"))).filter("tool_name = 't'").first()
    assert (row.approval_rate, row.success_rate) == (80.0, 80.0)
    none = tools.with_rates(report(spark, tool_result("none"))).first()
    assert none.approval_rate == 100.0


def test_both_tables_are_added(spark):
    row = report(spark, tool_result("t", duration="10"), old=[("t", False, 30, "e")]).first()
    assert (row.call_count, row.avg_duration_ms, row.error_count) == (2, 20.0, 1)


def test_time_range_is_inclusive_and_open_ended(spark):
    rows = [(*tool_result("t"), seconds) for seconds in (-1, 0, 10**7)]
    old = [("t", True, 1, None, -0.000001), ("t", True, 1, None, 0)]
    calls = events.unified_tool_events(legacy(spark, *old), logs(spark, *rows), START)
    assert tools.tool_metrics(calls).first().call_count == 3
    naive = START.replace(tzinfo=None)
    calls = events.unified_tool_events(legacy(spark, *old), logs(spark, *rows), naive)
    assert tools.tool_metrics(calls).first().call_count == 3


def test_named_ranges():
    assert since_for("last_hour", START) == START - timedelta(hours=1)
    assert since_for("last_day", START) == START - timedelta(hours=24)
    assert since_for("last_week", START) == START - timedelta(days=7)
    assert since_for("all_time", START) is None
    assert [range_label(n) for n in ("last_hour", "last_day", "last_week", "all_time")] == [
        "Last 1h",
        "Last 24h",
        "Last 7d",
        "All-time",
    ]


def test_classes(spark):
    metrics = report(
        spark,
        tool_result("Read"),
        tool_result("read_file"),
        tool_result("read"),
        tool_result("context7"),
        tool_result("context7"),
        tool_result("mcp__context7__query-docs"),
    )
    assert set(by(tools.builtin_tools(metrics), "tool_name")) == {"Read", "read_file"}
    others = by(tools.mcp_tools(metrics), "tool_name")
    assert set(others) == {"read", "context7", "mcp__context7__query-docs"}
    assert others["mcp__context7__query-docs"].display_name == "context7:query-docs"
    assert others["context7"].display_name == "context7"
    classes = by(tools.tool_classes(metrics), "is_builtin")
    assert (classes[True].tools, classes[True].calls) == (2, 2)
    assert (classes[False].tools, classes[False].calls) == (3, 4)
    named = by(tools.with_agent_name(tools.with_tool_class(metrics)), "tool_name")
    assert named["read_file"].agent_name == "OpenAI Codex"
    assert named["context7"].agent_name is None


def test_frequency_is_relative_to_the_class(spark):
    rows = [tool_result("Read")] * 4 + [tool_result("Bash")] + [tool_result("mine")] * 2
    found = by(tools.with_frequency(report(spark, *rows)), "tool_name")
    assert (found["Read"].freq_ratio, found["Read"].freq_tenths) == (1.0, 10)
    assert (found["Bash"].freq_ratio, found["Bash"].freq_tenths) == (0.25, 2)
    assert found["mine"].freq_tenths == 10


def test_servers(spark):
    rows = [
        tool_result("mcp__a__x", duration="10"),
        tool_result("mcp__a__y", "false", duration="40"),
        tool_result("mcp__plugin_p_b__z"),
        tool_result("plain"),
    ]
    found = by(tools.mcp_servers(report(spark, *rows)), "server")
    assert set(found) == {"a", "b"}
    assert (found["a"].tools, found["a"].calls, found["a"].errors) == (2, 2, 1)
    assert found["a"].avg_duration_ms == 25.0


def test_age(spark):
    rows = [(*tool_result("old"), 0), (*tool_result("just"), 8.5), (*tool_result("ahead"), 60)]
    found = by(tools.with_age(report(spark, *rows), at(10)), "tool_name")
    assert (found["old"].age_seconds, found["old"].is_active) == (10, False)
    assert (found["just"].age_seconds, found["just"].is_active) == (1, True)
    assert (found["ahead"].age_seconds, found["ahead"].is_active) == (None, True)


def test_health(spark):
    rows = [tool_result("good")]
    rows += [tool_result("warn", decision="approved")] * 9
    rows += [tool_result("warn", "false", decision="rejected")]
    found = by(tools.with_health(report(spark, *rows)), "tool_name")
    good, warn = found["good"], found["warn"]
    assert (good.approval_band, good.success_band, good.error_band) == ("good",) * 3
    assert (warn.approval_band, warn.success_band, warn.error_band) == ("warn", "warn", "bad")
    counted = {(r.measure, r.band): r.tools for r in tools.health_bands(report(spark, *rows)).collect()}
    assert counted == {
        ("approval", "good"): 1,
        ("approval", "warn"): 1,
        ("success", "good"): 1,
        ("success", "warn"): 1,
        ("error", "good"): 1,
        ("error", "bad"): 1,
    }


def test_empty_store(spark):
    metrics = report(spark)
    assert metrics.count() == 0
    totals = tools.tool_totals(metrics).first()
    assert (totals.tools, totals.total_calls) == (0, 0)


def test_last_error(spark):
    rows = [
        (*tool_result("t", "false", error="old"), 1),
        (*tool_result("t", "false", error="new"), 5),
        (*tool_result("t", "true", error="not failed"), 9),
        (*tool_result("t", None, error="silent"), 9),
        (*tool_result("t", "false"), 9),
        (*tool_result(None, "false", error="nameless"), 9),
        (*tool_result("u", "no", error="odd text"), 2),
    ]
    old = [("t", False, 1, "legacy", 3), ("v", False, 1, "v1", 1), ("v", True, 1, "fine", 2)]
    errors = events.tool_errors(legacy(spark, *old), logs(spark, *rows))
    found = {tool: row.error_msg for tool, row in by(events.last_errors(errors), "tool_name").items()}
    assert found == {"t": "new", "u": "odd text", "v": "v1"}
    assert [r.error_msg for r in events.last_error(errors, "t").collect()] == ["new"]
    assert events.last_error(errors, "unknown").count() == 0
    # a silent event is an error in the report all the same
    counted = by(tools.tool_metrics(events.logged_tool_calls(logs(spark, *rows))), "tool_name")
    assert counted["t"].error_count == 4


def test_last_error_tie(spark):
    rows = [(*tool_result("t", "false", error=e), 1) for e in ("first", "second")]
    errors = events.tool_errors(legacy(spark), logs(spark, *rows))
    assert events.last_errors(errors).first().error_msg == "second"
    assert events.last_error(errors, "t").first().error_msg == "second"


def test_last_error_ties_and_missing_times(spark):
    rows = [("tool_result", {"tool_name": "a", "success": "false", "error": text}, 5) for text in ("x", "z", "y")]
    old = legacy(spark, ("a", False, 1, "old", 4), ("b", False, 1, "b1", 9), ("b", False, 1, "b2", 9))
    errors = events.tool_errors(old, logs(spark, *rows))
    timeless = errors.limit(1).selectExpr("id", "cast(null as timestamp) as timestamp", "'c' as tool_name", "'n' as error_msg")
    errors = errors.unionByName(timeless).unionByName(errors)  # every row twice
    want = {"a": "y", "b": "b2", "c": "n"}  # equal times go by id
    for last in (events.last_errors, events.newest_errors):
        assert {r.tool_name: r.error_msg for r in last(errors).collect()} == want


def opened(frame):
    return {f.split("event_date=")[1][:10] for f in frame.inputFiles()}


def test_the_last_error_of_one_tool_reads_the_newest_days_only(spark, tmp_path):
    root = str(tmp_path)
    failed = [("tool_result", {"tool_name": t, "success": "false", "error": f"{t}{d}"}, 86400 * d) for d, t in enumerate("abcdefgh")]
    tables.append(logs(spark, *failed), root, "log_events", "one")
    tables.append(legacy(spark, ("a", False, 1, "old", -86400), ("h", False, 1, "h-old", 0)), root, "tool_events", "one")
    newest = search_last_error(spark, root, "h")
    assert newest.first().error_msg == "h7" and opened(newest) == {"2024-01-17"}
    earlier = search_last_error(spark, root, "f")
    assert earlier.first().error_msg == "f5" and opened(earlier) == {"2024-01-15", "2024-01-16"}
    assert search_last_error(spark, root, "a").first().error_msg == "a0"
    assert search_last_error(spark, root, "nobody").count() == 0
    assert search_last_error(spark, str(tmp_path / "none"), "a").count() == 0
