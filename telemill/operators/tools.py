"""The per-tool report and what is derived from it.

Everything here except ``tool_metrics`` works on one row per tool, after the
aggregation, so name parsing, joins and sorts never touch single events.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.fixed_values import ACTIVE_WITHIN_SECONDS, AGENTS, FREQUENCY_STEPS, Agent
from telemill.functions import attributes as A
from telemill.functions import names, rates
from telemill.operators.events import last_errors
from telemill.sources.agents import agent_dim, tool_dim


def tool_metrics(events: DataFrame, *more: Column) -> DataFrame:
    """Calls, durations, outcomes and decisions per tool, and what else is asked for.

    All buffers are fixed-width, so each task aggregates by hash before the
    shuffle and a hot tool sends one row per task.
    """
    return events.groupBy("tool_name").agg(
        F.count("*").alias("call_count"),
        F.max("timestamp").alias("last_call"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.min("duration_ms").alias("min_duration_ms"),
        F.max("duration_ms").alias("max_duration_ms"),
        F.count_if(F.col("success")).alias("success_count"),
        F.count_if(~F.col("success")).alias("error_count"),
        F.count_if(A.is_approval(F.col("decision"))).alias("approved_count"),
        F.count_if(A.is_rejection(F.col("decision"))).alias("rejected_count"),
        F.count_if(F.col("bad_duration")).alias("bad_duration_count"),
        *more,
    )


def tool_totals(metrics: DataFrame) -> DataFrame:
    """Calls and tools in all; one row, also for an empty report."""
    return metrics.agg(
        F.count("*").alias("tools"),
        F.coalesce(F.sum("call_count"), F.lit(0)).alias("total_calls"),
        F.coalesce(F.sum("error_count"), F.lit(0)).alias("total_errors"),
    )


def with_tool_class(metrics: DataFrame, agents: Sequence[Agent] = AGENTS) -> DataFrame:
    """Add the agent a built-in tool belongs to, and whether the tool is built in."""
    dim = tool_dim(metrics.sparkSession, agents)
    return metrics.join(dim, "tool_name", "left").withColumn(
        "is_builtin", F.col("agent").isNotNull()
    )


def with_agent_name(table: DataFrame, agents: Sequence[Agent] = AGENTS) -> DataFrame:
    """Add the display name of the agent in column ``agent``."""
    dim = agent_dim(table.sparkSession, agents).select("agent", "agent_name")
    return table.join(dim, "agent", "left")


def builtin_tools(metrics: DataFrame, agents: Sequence[Agent] = AGENTS) -> DataFrame:
    """Tools that some agent lists as its own."""
    return metrics.join(tool_dim(metrics.sparkSession, agents), "tool_name", "left_semi")


def mcp_tools(metrics: DataFrame, agents: Sequence[Agent] = AGENTS) -> DataFrame:
    """All other tools, whatever their name looks like, with the name to show."""
    others = metrics.join(tool_dim(metrics.sparkSession, agents), "tool_name", "left_anti")
    return others.withColumn("display_name", names.display_name(F.col("tool_name")))


def tool_classes(metrics: DataFrame, agents: Sequence[Agent] = AGENTS) -> DataFrame:
    """Number of tools and calls, built-in against MCP."""
    return (
        with_tool_class(metrics, agents)
        .groupBy("is_builtin")
        .agg(
            F.count("*").alias("tools"),
            F.sum("call_count").alias("calls"),
            F.sum("error_count").alias("errors"),
        )
    )


def mcp_servers(metrics: DataFrame) -> DataFrame:
    """Report per MCP server, over the tools whose name states one."""
    total_duration = F.sum(F.col("avg_duration_ms") * F.col("call_count"))
    return (
        metrics.withColumn("server", names.mcp_server(F.col("tool_name")))
        .filter(F.col("server").isNotNull())
        .groupBy("server")
        .agg(
            F.count("*").alias("tools"),
            F.sum("call_count").alias("calls"),
            F.sum("error_count").alias("errors"),
            F.max("last_call").alias("last_call"),
            (total_duration / F.sum("call_count")).alias("avg_duration_ms"),
            F.min("min_duration_ms").alias("min_duration_ms"),
            F.max("max_duration_ms").alias("max_duration_ms"),
        )
    )


def with_rates(metrics: DataFrame) -> DataFrame:
    """Add approval and success percentages."""
    return metrics.withColumns(
        {
            "approval_rate": rates.approval_rate(F.col("approved_count"), F.col("rejected_count")),
            "success_rate": rates.success_rate(F.col("success_count"), F.col("call_count")),
        }
    )


def with_last_error(metrics: DataFrame, errors: DataFrame) -> DataFrame:
    """Add the newest error text of each tool that has errors in the report.

    The text may be older than the report's time range. Both sides are
    aggregated by tool already, so the join needs no shuffle of its own.
    """
    newest = last_errors(errors).select("tool_name", F.col("error_msg").alias("last_error"))
    return metrics.join(newest, "tool_name", "left").withColumn(
        "last_error", F.when(F.col("error_count") > 0, F.col("last_error"))
    )


def with_age(metrics: DataFrame, as_of: datetime) -> DataFrame:
    """Add whole seconds since the last call, NULL if it lies ahead, and whether it is recent."""
    seconds = F.timestamp_diff("SECOND", F.col("last_call"), A.utc_literal(as_of))
    return metrics.withColumns(
        {
            "age_seconds": F.when(seconds >= 0, seconds),
            "is_active": F.coalesce(seconds < ACTIVE_WITHIN_SECONDS, F.lit(False)),
        }
    )


def with_frequency(metrics: DataFrame, agents: Sequence[Agent] = AGENTS) -> DataFrame:
    """Add each tool's calls relative to the busiest tool of its class.

    The maxima and the rows read the same exchange of the report. The maxima
    are one row per class, at most two, so they are broadcast; a window over a
    class would put all its tools in one task.
    """
    classed = with_tool_class(metrics, agents)
    busiest = classed.groupBy("is_builtin").agg(F.max("call_count").alias("_busiest"))
    ratio = F.col("call_count") / F.col("_busiest")
    return (
        classed.join(F.broadcast(busiest), "is_builtin")
        .withColumns(
            {
                "freq_ratio": ratio,
                "freq_tenths": F.floor(ratio * FREQUENCY_STEPS),
            }
        )
        .drop("_busiest")
    )


def with_health(metrics: DataFrame) -> DataFrame:
    """Add a band for approvals, successes and errors."""
    return with_rates(metrics).withColumns(
        {
            "approval_band": rates.approval_band(F.col("approval_rate")),
            "success_band": rates.success_band(F.col("success_rate")),
            "error_band": rates.error_band(F.col("error_count")),
        }
    )


def health_bands(metrics: DataFrame) -> DataFrame:
    """Number of tools in each band of each measure."""
    bands = F.explode(
        F.array(
            *[
                F.struct(F.lit(measure).alias("measure"), F.col(f"{measure}_band").alias("band"))
                for measure in ("approval", "success", "error")
            ]
        )
    )
    return (
        with_health(metrics)
        .select(bands.alias("b"))
        .groupBy(F.col("b.measure").alias("measure"), F.col("b.band").alias("band"))
        .agg(F.count("*").alias("tools"))
    )
