from __future__ import annotations

import json
from datetime import datetime, timezone

import pytest

from telemill.sources import otlp
from tests.helpers import START, utc

NANOS = 1704888000123456789  # 2024-01-10 12:00:00.123456789


def attribute(key, **value):
    return {"key": key, "value": value}


def log_request(*records):
    return {"resourceLogs": [{"scopeLogs": [{"logRecords": list(records)}]}]}


def metric_request(*metrics):
    return {"resourceMetrics": [{"scopeMetrics": [{"metrics": list(metrics)}]}]}


def payload_frame(spark, *payloads):
    rows = [(p if isinstance(p, str) else json.dumps(p), START) for p in payloads]
    return spark.createDataFrame(rows, "payload string, ingest_ts timestamp")


def parsed_logs(spark, *payloads):
    events, bad = otlp.parse_logs(payload_frame(spark, *payloads))
    return events.collect(), [row.payload for row in bad.collect()]


def parsed_metrics(spark, *payloads, profile="json"):
    points, bad = otlp.parse_metrics(payload_frame(spark, *payloads))
    routed = [frame.drop("id").collect() for frame in otlp.route_metrics(points, profile)]
    return routed, [row.payload for row in bad.collect()]


def test_log_record(spark):
    record = {
        "timeUnixNano": str(NANOS),
        "severityText": "INFO",
        "body": {"stringValue": "a body"},
        "attributes": [
            attribute("event.name", stringValue="tool_result"),
            attribute("tool_name", stringValue="Read"),
            attribute("success", boolValue=True),
            attribute("duration_ms", intValue="50"),
            attribute("plain", intValue=7),
            attribute("signed", intValue="-0012"),
            attribute("real", doubleValue=3.0),
            attribute("tiny", doubleValue=1e-7),
            attribute("large", doubleValue=1e21),
            attribute("whole real", doubleValue=4),
        ],
    }
    (event,), bad = parsed_logs(spark, log_request(record))
    assert bad == []
    assert event.event_name == "tool_result"
    assert event.body == "a body"
    assert utc(event.timestamp) == datetime(2024, 1, 10, 12, 0, 0, 123456, timezone.utc)
    assert event.attributes == {
        "event.name": "tool_result",
        "tool_name": "Read",
        "success": "true",
        "duration_ms": "50",
        "plain": "7",
        "signed": "-12",
        "real": "3",
        "tiny": "0.0000001",
        "large": "1000000000000000000000",
        "whole real": "4",
    }


def test_value_precedence_and_dropped_values(spark):
    record = {
        "attributes": [
            attribute("all", stringValue="s", intValue=1, doubleValue=2.5, boolValue=False),
            attribute("three", intValue=1, doubleValue=2.5, boolValue=False),
            attribute("two", doubleValue=2.5, boolValue=False),
            attribute("null text", stringValue=None, boolValue=False),
            attribute("list", arrayValue={"values": [{"stringValue": 5}]}),
            attribute("nothing"),
        ]
    }
    (event,), _ = parsed_logs(spark, log_request(record))
    assert event.attributes == {"all": "s", "three": "1", "two": "2.5", "null text": "false"}
    assert (event.event_name, event.body) == (None, None)


def test_repeated_keys(spark):
    record = {
        "attributes": [
            attribute("event.name", stringValue="first"),
            attribute("event.name", stringValue="second"),
            attribute("k", stringValue="a"),
            attribute("k", intValue=2),
            attribute("k"),
        ]
    }
    (event,), _ = parsed_logs(spark, log_request(record))
    assert event.event_name == "first"
    assert event.attributes == {"event.name": "second", "k": "2"}
    record = {"attributes": [attribute("event.name", intValue=5), attribute("event.name", stringValue="x")]}
    (event,), _ = parsed_logs(spark, log_request(record))
    assert event.event_name is None


@pytest.mark.parametrize(
    "nanos, moment",
    [
        (NANOS, datetime(2024, 1, 10, 12, 0, 0, 123456, timezone.utc)),
        ("0", datetime(1970, 1, 1, tzinfo=timezone.utc)),
        (0, datetime(1970, 1, 1, tzinfo=timezone.utc)),
        (None, START),
        ("18446744073709551615", datetime(1969, 12, 31, 23, 59, 59, 999999, timezone.utc)),
        (18446744073709551615, datetime(1969, 12, 31, 23, 59, 59, 999999, timezone.utc)),
        ("+5000", datetime(1970, 1, 1, 0, 0, 0, 5, timezone.utc)),
    ],
)
def test_record_time(spark, nanos, moment):
    (event,), bad = parsed_logs(spark, log_request({"timeUnixNano": nanos}))
    assert bad == []
    assert utc(event.timestamp) == moment


def test_time_zero_in_the_proto_profile(spark):
    frame = payload_frame(spark, log_request({"timeUnixNano": "0"}, {"timeUnixNano": NANOS}))
    events, _ = otlp.parse_logs(frame, profile="proto")
    assert sorted(utc(e.timestamp) for e in events.collect()) == [
        START,
        datetime(2024, 1, 10, 12, 0, 0, 123456, timezone.utc),
    ]
    with pytest.raises(ValueError):
        otlp.parse_logs(frame, profile="xml")


def test_record_without_time_gets_arrival_time(spark):
    (event,), _ = parsed_logs(spark, log_request({}))
    assert utc(event.timestamp) == START
    assert event.attributes == {}


def test_all_levels_are_unnested(spark):
    request = {
        "resourceLogs": [
            {"resource": {"attributes": None}, "scopeLogs": [{"scope": {"name": 5}, "logRecords": [{}, {}]}]},
            {"scopeLogs": [{"logRecords": []}, {"logRecords": [{}]}]},
            {"scopeLogs": []},
        ]
    }
    events, bad = parsed_logs(spark, request, {"resourceLogs": []}, "")
    assert (len(events), bad) == (3, [])
    assert len({event.id for event in events}) == 3


GOOD = {"attributes": [attribute("k", stringValue="v")]}
BAD_LOGS = [
    "garbage",
    "null",
    "5",
    "{",
    "{}",
    '{"resourceLogs":[]} trailing',
    '{"resourceLogs":[]},{"resourceLogs":[]}',
    "{'resourceLogs':[]}",
    [{"resourceLogs": []}],
    {"resourceLogs": None},
    {"resourceLogs": {}},
    {"resourceLogs": [None]},
    {"resourceLogs": [{}]},
    {"resourceLogs": [{"scopeLogs": [{}]}]},
    {"resourceLogs": [{"scopeLogs": [{"logRecords": None}]}]},
    log_request(None),
    log_request(GOOD, {"timeUnixNano": "soon"}),
    log_request(GOOD, {"timeUnixNano": "-1"}),
    log_request(GOOD, {"timeUnixNano": -1}),
    log_request(GOOD, {"timeUnixNano": 17.5}),
    log_request(GOOD, {"timeUnixNano": " 17"}),
    log_request(GOOD, {"timeUnixNano": True}),
    log_request(GOOD, {"timeUnixNano": "18446744073709551616"}),
    log_request(GOOD, {"body": "text"}),
    log_request(GOOD, {"body": {"stringValue": 5}}),
    log_request(GOOD, {"attributes": None}),
    log_request(GOOD, {"attributes": {}}),
    log_request(GOOD, {"attributes": [None]}),
    log_request(GOOD, {"attributes": [{"key": "k"}]}),
    log_request(GOOD, {"attributes": [{"key": "k", "value": None}]}),
    log_request(GOOD, {"attributes": [{"key": "k", "value": "v"}]}),
    log_request(GOOD, {"attributes": [{"value": {}}]}),
    log_request(GOOD, {"attributes": [{"key": None, "value": {}}]}),
    log_request(GOOD, {"attributes": [{"key": 5, "value": {}}]}),
    log_request(GOOD, {"attributes": [attribute("k", stringValue=5)]}),
    log_request(GOOD, {"attributes": [attribute("k", stringValue=["v"])]}),
    log_request(GOOD, {"attributes": [attribute("k", intValue="five")]}),
    log_request(GOOD, {"attributes": [attribute("k", intValue=5.0)]}),
    log_request(GOOD, {"attributes": [attribute("k", intValue="9223372036854775808")]}),
    log_request(GOOD, {"attributes": [attribute("k", doubleValue="1.5")]}),
    log_request(GOOD, {"attributes": [attribute("k", doubleValue="NaN")]}),
    log_request(GOOD, {"attributes": [attribute("k", boolValue="true")]}),
    log_request(GOOD, {"attributes": [attribute("k", boolValue=1)]}),
]


def test_bad_log_payloads_are_kept_whole(spark):
    good = log_request(GOOD)
    events, bad = parsed_logs(spark, good, *BAD_LOGS, good)
    expected = sorted(p if isinstance(p, str) else json.dumps(p) for p in BAD_LOGS)
    assert sorted(bad) == expected
    assert len(events) == 2


def metric(name, kind="sum", *points, **more):
    return {"name": name, kind: {"dataPoints": list(points)}, **more}


def token_type(name):
    return [attribute("type", stringValue=name)]


def test_metric_routing(spark):
    request = metric_request(
        metric(
            "claude_code.token.usage",
            "sum",
            {"asInt": "5000", "attributes": token_type("input")},
            {"asInt": 7, "attributes": token_type("cacheRead")},
            {"asInt": 1, "attributes": [*token_type("first"), *token_type("second")]},
            {"asInt": 2, "attributes": [attribute("type", intValue=1)]},
            {"asDouble": 9.5},
            {"asInt": None},
        ),
        metric("claude_code.cost.usage", "gauge", {"asDouble": 0.05}, {"asInt": "3"}),
        metric("claude_code.lines_of_code.count", "sum", {"asInt": "-30"}, {"asDouble": 4.5}),
        metric("claude_code.commit.count", "sum", {"asInt": 2}),
        metric("claude_code.pull_request.count", "sum", {"asInt": 1}),
        metric("claude_code.active_time.total", "sum", {"asInt": 60}),
        metric("claude_code.session.count", "sum", {"asInt": 1}),
        metric("other.metric", "sum", {"asInt": 1}),
        metric("claude_code.commit.count", "histogram", {"count": 1}),
    )
    (tokens, costs, sessions), bad = parsed_metrics(spark, request)
    assert bad == []
    assert sorted((r.token_type, r["count"]) for r in tokens) == [
        ("cacheRead", 7),
        ("first", 1),
        ("input", 5000),
        ("unknown", 0),
        ("unknown", 0),
        ("unknown", 2),
    ]
    assert sorted(r.cost_usd for r in costs) == [0.0, 0.05]
    assert sorted((r.metric_name, r.value) for r in sessions) == [
        ("active_time", 60),
        ("commit", 2),
        ("lines_of_code", -30),
        ("lines_of_code", 0),
        ("pull_request", 1),
    ]
    assert {utc(r.timestamp) for r in [*tokens, *costs, *sessions]} == {START}

    (tokens, costs, sessions), _ = parsed_metrics(spark, request, profile="proto")
    assert sum(r["count"] for r in tokens) == 5000 + 7 + 1 + 2 + 9
    assert sorted(r.cost_usd for r in costs) == [0.05, 3.0]
    assert ("session", 1) in {(r.metric_name, r.value) for r in sessions}
    assert ("lines_of_code", 4) in {(r.metric_name, r.value) for r in sessions}


def test_sum_stands_before_gauge(spark):
    name = "claude_code.commit.count"
    points = {"dataPoints": [{"asInt": 1}]}
    cases = [
        ({"sum": points, "gauge": {"dataPoints": [{"asInt": 2}]}}, [1]),
        ({"sum": {"dataPoints": []}, "gauge": points}, []),
        ({"sum": None, "gauge": points}, [1]),
        ({}, []),
    ]
    for kinds, expected in cases:
        (_, _, sessions), bad = parsed_metrics(spark, metric_request({"name": name, **kinds}))
        assert ([r.value for r in sessions], bad) == (expected, [])


GOOD_METRIC = metric("claude_code.commit.count", "sum", {"asInt": 2})
BAD_METRICS = [
    "garbage",
    "{}",
    {"resourceMetrics": None},
    {"resourceMetrics": [{"scopeMetrics": [{}]}]},
    metric_request(None),
    metric_request(GOOD_METRIC, {"sum": {"dataPoints": []}}),
    metric_request(GOOD_METRIC, {"name": 5}),
    metric_request(GOOD_METRIC, {"name": None}),
    metric_request(GOOD_METRIC, {"name": "x", "sum": {}}),
    metric_request(GOOD_METRIC, {"name": "x", "gauge": {"dataPoints": None}}),
    metric_request(GOOD_METRIC, metric("x", "sum", {"asInt": "many"})),
    metric_request(GOOD_METRIC, metric("x", "sum", {"asInt": 1.5})),
    metric_request(GOOD_METRIC, metric("x", "gauge", {"asDouble": "1.5"})),
    metric_request(GOOD_METRIC, metric("x", "sum", {"attributes": None})),
    metric_request(GOOD_METRIC, metric("x", "sum", {"attributes": [{"key": "k"}]})),
    metric_request(GOOD_METRIC, metric("x", "sum", {"attributes": [attribute("k", stringValue=1)]})),
    metric_request(GOOD_METRIC, metric("x", "sum", None)),
]


def test_bad_metric_payloads_are_kept_whole(spark):
    good = metric_request(GOOD_METRIC)
    (_, _, sessions), bad = parsed_metrics(spark, good, *BAD_METRICS, good)
    expected = sorted(p if isinstance(p, str) else json.dumps(p) for p in BAD_METRICS)
    assert sorted(bad) == expected
    assert [r.value for r in sessions] == [2, 2]


def test_payload_is_parsed_once(spark):
    for parse in (otlp.parse_logs, otlp.parse_metrics):
        events, _ = parse(payload_frame(spark, "{}"))
        plan = events._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index("Generate posexplode") :]
        assert "Filter" not in below


def test_line_end_after_a_whole_number_is_not_read(spark):
    assert spark.sql(f"select {otlp._signed(chr(39) + '5' + chr(39))} as x").first().x == 5
    bad = spark.createDataFrame([("5\n",)], "v string")
    assert bad.selectExpr(f"{otlp._signed('v')} as x").first().x is None
    assert bad.selectExpr(f"{otlp._unsigned_wrapped('v')} as x").first().x is None


def test_numbers_that_no_double_holds_are_refused(spark):
    text = json.dumps(log_request({"attributes": [attribute("x", doubleValue=0.5)]}))
    large = text.replace("0.5", "1e400")
    events, bad = parsed_logs(spark, text, large)
    assert (len(events), bad) == (1, [large])
    text = json.dumps(metric_request(metric("claude_code.cost.usage", "sum", {"asDouble": 0.5})))
    large = text.replace("0.5", "-1e400")
    (_, costs, _), bad = parsed_metrics(spark, text, large)
    assert (len(costs), bad) == (1, [large])
