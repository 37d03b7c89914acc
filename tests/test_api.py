from __future__ import annotations

from telemill.operators import agents, api, events
from tests.helpers import at, by, legacy, logs, tool_result, utc


def request(model, name="api_request", **latency):
    attributes = {"model": model, **latency}
    return name, {key: value for key, value in attributes.items() if value is not None}


def test_calls_and_latency_by_model(spark):
    frame = logs(
        spark,
        request("m1", latency_ms="100", duration_ms="900"),
        request("m1", name="claude_code.api_request", duration_ms="200.5"),
        request(None, latency_ms="50"),
        request("m2"),
        request("m2", latency_ms="slow", duration_ms="10"),
        ("api_error", {"model": "m1"}),
        ("x.api_error", {}),
        ("api_requested", {"model": "m1"}),
    )
    found = by(api.api_by_model(frame), "model")
    assert (found["m1"].calls, found["m1"].avg_latency_ms) == (2, 150.25)
    assert (found[None].calls, found[None].avg_latency_ms) == (1, 50.0)
    assert (found["m2"].calls, found["m2"].avg_latency_ms) == (2, 0.0)
    assert found["m2"].bad_latency_count == 1
    totals = api.api_totals(frame).first()
    assert (totals.total_calls, totals.total_errors) == (5, 2)
    assert totals.avg_latency_ms == 350.5 / 5
    assert set(by(api.calls_per_model(frame), "model")) == {"m1", "m2"}


def test_totals_without_events(spark):
    row = api.api_totals(logs(spark)).first()
    assert (row.total_calls, row.total_errors, row.avg_latency_ms) == (0, 0, 0.0)


def test_totals_in_a_range(spark):
    frame = logs(spark, (*request("m", latency_ms="10"), 0), (*request("m", latency_ms="30"), 5))
    row = api.api_totals(frame, since=at(5)).first()
    assert (row.total_calls, row.avg_latency_ms) == (1, 30.0)


def test_top_models(spark):
    calls = [("b", 2), ("a", 2), ("claude-opus-4-20250514", 5), ("z", 1)]
    frame = logs(spark, *[request(model) for model, n in calls for _ in range(n)])
    rows = api.top_models(frame).collect()
    assert {(r.model, r.short_model, r.calls) for r in rows} == {
        ("claude-opus-4-20250514", "opus-4", 5),
        ("a", "a", 2),
        ("b", "b", 2),
    }


def test_usage_by_short_model(spark):
    frame = logs(
        spark,
        request("gpt-4o-mini", latency_ms="10"),
        request("gpt-4o", latency_ms="40"),
        request("gpt-4o", latency_ms="40"),
        request(None),
    )
    row = api.usage_by_short_model(frame).collect()
    assert len(row) == 1
    assert (row[0].short_model, row[0].models, row[0].calls) == ("gpt-4o", 2, 3)
    assert row[0].avg_latency_ms == 30.0


def test_detected_agents_in_order_of_first_sight(spark):
    frame = logs(
        spark,
        (*tool_result("mine"), 0),
        (*request("qwen-coder"), 1),
        (*tool_result("Read"), 2),
        (*tool_result("read_file"), 3),
        (*request("unknown"), 3),
        (*request("gemini-pro"), 4),
    )
    old = legacy(spark, ("Bash", True, 1, None, 1.5))
    calls = events.unified_tool_events(old, frame)
    found = agents.detected_agents(calls, api.api_requests(frame)).orderBy("position").collect()
    assert [(r.position, r.agent, utc(r.first_seen)) for r in found] == [
        (1, "qwen_code", at(1)),
        (2, "claude_code", at(1.5)),
        (3, "openai_codex", at(3)),
        (4, "gemini_cli", at(4)),
    ]
    sightings = by(agents.agent_sightings(frame).groupBy("agent").count(), "agent")
    assert {a: r["count"] for a, r in sightings.items()} == {
        "qwen_code": 1,
        "claude_code": 1,
        "openai_codex": 1,
        "gemini_cli": 1,
    }


def test_events_by_prefix(spark):
    frame = logs(spark, ("claude_code.x", {}), ("codex.y", {}), ("claude_code.z", {}), ("w", {}))
    found = {a: r.events for a, r in by(agents.events_by_prefix_agent(frame), "agent").items()}
    assert found == {"claude_code": 2, "openai_codex": 1, None: 1}
