"""Columns of the five tables, of the quarantine, and of stored partial results."""

from __future__ import annotations

from pyspark.sql import types as T

_ID = T.StructField("id", T.LongType())
_TIMESTAMP = T.StructField("timestamp", T.TimestampType())

LOG_EVENTS = T.StructType(
    [
        _ID,
        _TIMESTAMP,
        T.StructField("event_name", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
    ]
)
TOOL_EVENTS = T.StructType(
    [
        _ID,
        _TIMESTAMP,
        T.StructField("tool_name", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)
TOKEN_USAGE = T.StructType(
    [
        _ID,
        _TIMESTAMP,
        T.StructField("token_type", T.StringType()),
        T.StructField("count", T.LongType()),
    ]
)
COST_USAGE = T.StructType([_ID, _TIMESTAMP, T.StructField("cost_usd", T.DoubleType())])
SESSION_METRICS = T.StructType(
    [
        _ID,
        _TIMESTAMP,
        T.StructField("metric_name", T.StringType()),
        T.StructField("value", T.LongType()),
    ]
)
QUARANTINE = T.StructType([_TIMESTAMP, T.StructField("payload", T.StringType())])
# Partial results of a slice of time, see ``operators.partials``; ``timestamp`` is its start.
_COUNTS = ("success_count", "error_count", "approved_count", "rejected_count", "bad_duration_count")
TOOL_PARTIALS = T.StructType(
    [
        _TIMESTAMP,
        T.StructField("tool_name", T.StringType()),
        T.StructField("call_count", T.LongType()),
        T.StructField("last_call", T.TimestampType()),
        T.StructField("duration_sum", T.DoubleType()),
        T.StructField("min_duration_ms", T.LongType()),
        T.StructField("max_duration_ms", T.LongType()),
        *[T.StructField(name, T.LongType()) for name in _COUNTS],
    ]
)
API_PARTIALS = T.StructType(
    [
        _TIMESTAMP,
        T.StructField("model", T.StringType()),
        T.StructField("call_count", T.LongType()),
        T.StructField("error_count", T.LongType()),
        T.StructField("latency_sum", T.DoubleType()),
        T.StructField("bad_latency_count", T.LongType()),
    ]
)
TOKEN_PARTIALS = T.StructType(TOKEN_USAGE.fields[1:])
COST_PARTIALS = T.StructType(COST_USAGE.fields[1:])
SESSION_PARTIALS = T.StructType(SESSION_METRICS.fields[1:])

TABLES = {
    "log_events": LOG_EVENTS,
    "tool_events": TOOL_EVENTS,
    "token_usage": TOKEN_USAGE,
    "cost_usage": COST_USAGE,
    "session_metrics": SESSION_METRICS,
    "bad_log_payloads": QUARANTINE,
    "bad_metric_payloads": QUARANTINE,
    "tool_panes": TOOL_PARTIALS,
    "api_panes": API_PARTIALS,
    "tool_days": TOOL_PARTIALS,
    "api_days": API_PARTIALS,
    "token_days": TOKEN_PARTIALS,
    "cost_days": COST_PARTIALS,
    "session_days": SESSION_PARTIALS,
}
