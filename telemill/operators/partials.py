"""Partial results that merge: counts, sums and extremes per time slice, and reports made of them.

A partial result of some rows and one of other rows merge into that of both, so
a report over a range is made of stored partials for its whole slices, and of
the rows themselves only where a slice is cut. ``timestamp`` is the start of
the slice; averages are kept as sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions import attributes as A

PANE = "minute"
_TOOL_COUNTS = ("success_count", "error_count", "approved_count", "rejected_count", "bad_duration_count")


def tool_partials(calls: DataFrame, slice_start: Column) -> DataFrame:
    """Partial tool reports per slice and tool."""
    return calls.groupBy(slice_start.alias("timestamp"), "tool_name").agg(
        F.count("*").alias("call_count"),
        F.max("timestamp").alias("last_call"),
        F.sum(F.col("duration_ms").cast("double")).alias("duration_sum"),
        F.min("duration_ms").alias("min_duration_ms"),
        F.max("duration_ms").alias("max_duration_ms"),
        F.count_if(F.col("success")).alias("success_count"),
        F.count_if(~F.col("success")).alias("error_count"),
        F.count_if(A.is_approval(F.col("decision"))).alias("approved_count"),
        F.count_if(A.is_rejection(F.col("decision"))).alias("rejected_count"),
        F.count_if(F.col("bad_duration")).alias("bad_duration_count"),
    )


def merged_tool_metrics(partials: DataFrame) -> DataFrame:
    """The tool report of partials, with the columns of ``tools.tool_metrics``."""
    calls = F.sum("call_count")
    return partials.groupBy("tool_name").agg(
        calls.alias("call_count"),
        F.max("last_call").alias("last_call"),
        (F.sum("duration_sum") / calls).alias("avg_duration_ms"),
        F.min("min_duration_ms").alias("min_duration_ms"),
        F.max("max_duration_ms").alias("max_duration_ms"),
        *[F.sum(name).alias(name) for name in _TOOL_COUNTS],
    )


def api_partials(logs: DataFrame, slice_start: Column | None, *more: Column) -> DataFrame:
    """Partial API reports per slice, if there are any, and model; errors count with the model they name."""
    request, error = A.is_family(logs, "api_request"), A.is_family(logs, "api_error")
    events = logs.filter(request | error)
    keys = [] if slice_start is None else [slice_start.alias("timestamp")]
    return events.groupBy(*keys, A.attribute(events, "model").alias("model")).agg(
        F.count_if(request).alias("call_count"),
        F.count_if(error).alias("error_count"),
        F.coalesce(F.sum(F.when(request, A.latency_ms(events))), F.lit(0.0)).alias("latency_sum"),
        F.count_if(request & A.bad_latency(events)).alias("bad_latency_count"),
        *more,
    )


def merged_api_totals(partials: DataFrame) -> DataFrame:
    """Calls, errors and mean latency of partials: one row, with the columns of ``api.api_totals``."""
    calls = F.coalesce(F.sum("call_count"), F.lit(0))
    mean = F.try_divide(F.sum("latency_sum"), calls)
    return partials.agg(
        calls.alias("total_calls"),
        F.coalesce(F.sum("error_count"), F.lit(0)).alias("total_errors"),
        F.coalesce(mean, F.lit(0.0)).alias("avg_latency_ms"),
    )


def merged_api_by_model(partials: DataFrame) -> DataFrame:
    """Calls and mean latency per model of partials, with the columns of ``api.api_by_model``."""
    calls = F.sum("call_count")
    return (
        partials.where("call_count > 0")
        .groupBy("model")
        .agg(
            calls.alias("calls"),
            (F.sum("latency_sum") / calls).alias("avg_latency_ms"),
            F.sum("bad_latency_count").alias("bad_latency_count"),
        )
    )


def token_partials(tokens: DataFrame, slice_start: Column) -> DataFrame:
    """Tokens per slice and type: rows like those they are made of, so the reports of ``usage`` take them."""
    return tokens.groupBy(slice_start.alias("timestamp"), "token_type").agg(F.sum("count").alias("count"))


def cost_partials(costs: DataFrame, slice_start: Column) -> DataFrame:
    return costs.groupBy(slice_start.alias("timestamp")).agg(F.sum("cost_usd").alias("cost_usd"))


def session_partials(metrics: DataFrame, slice_start: Column) -> DataFrame:
    return metrics.groupBy(slice_start.alias("timestamp"), "metric_name").agg(F.sum("value").alias("value"))
