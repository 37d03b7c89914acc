"""Tool calls and tool errors, read alike from both event tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions import attributes as A
from telemill.session import stored


def logged_tool_calls(logs: DataFrame, since: datetime | None = None) -> DataFrame:
    """Tool calls among the log events."""
    results = since_results(logs, since)
    return results.select(
        "id",
        "timestamp",
        A.tool_name(results).alias("tool_name"),
        A.duration_ms(results).alias("duration_ms"),
        A.success(results).alias("success"),
        A.attribute(results, "decision").alias("decision"),
        A.bad_duration(results).alias("bad_duration"),
    )


def since_results(logs: DataFrame, since: datetime | None) -> DataFrame:
    return A.since_filter(logs, since).filter(A.is_family(logs, "tool_result"))


def legacy_tool_calls(legacy: DataFrame, since: datetime | None = None) -> DataFrame:
    """Tool calls of the older typed table, which knows no decisions."""
    return A.since_filter(legacy, since).select(
        "id",
        "timestamp",
        "tool_name",
        "duration_ms",
        "success",
        F.lit(None).cast("string").alias("decision"),
        F.lit(False).alias("bad_duration"),
    )


def unified_tool_events(
    legacy: DataFrame, logs: DataFrame, since: datetime | None = None
) -> DataFrame:
    """All tool calls; a call present in both tables counts twice."""
    return legacy_tool_calls(legacy, since).unionByName(logged_tool_calls(logs, since))


def tool_errors(legacy: DataFrame, logs: DataFrame, since: datetime | None = None) -> DataFrame:
    """Failed calls that carry an error text.

    A log event that does not state its success is not in here, although
    ``tool_metrics`` counts it among the errors.
    """
    old = (
        A.since_filter(legacy, since)
        .filter(~F.col("success") & F.col("error").isNotNull())
        .select("id", "timestamp", "tool_name", F.col("error").alias("error_msg"))
    )
    return old.unionByName(logged_tool_errors(logs, since))


def logged_tool_errors(logs: DataFrame, since: datetime | None = None) -> DataFrame:
    """The failed calls with an error text among the log events."""
    results = since_results(logs, since)
    return (
        results.filter(A.said_unsuccessful(results) & A.attribute(results, "error").isNotNull())
        .filter(A.attribute(results, "tool_name").isNotNull())
        .select(
            "id",
            "timestamp",
            A.attribute(results, "tool_name").alias("tool_name"),
            A.attribute(results, "error").alias("error_msg"),
        )
    )


def last_error(errors: DataFrame, tool: str) -> DataFrame:
    """Newest error of one tool: one row, or none."""
    return (
        errors.filter(F.col("tool_name") == tool)
        .orderBy(F.desc("timestamp"), F.desc("id"), F.desc("error_msg"))
        .limit(1)
        .select("tool_name", "timestamp", "error_msg")
    )


def last_errors(errors: DataFrame) -> DataFrame:
    """Newest error of every tool.

    The newest time per tool comes first, from a hash aggregation that never
    touches the texts, and is written down: a row per tool, of known size, so
    that Catalyst sends it to the errors if it is small and shuffles if not.
    Only errors of these moments are then ranked by id and text.
    """
    newest = stored(errors.groupBy("tool_name").agg(F.max("timestamp").alias("_newest")), "newest-errors")
    newest = newest.withColumnRenamed("tool_name", "_tool")
    same = (F.col("tool_name") == F.col("_tool")) & F.col("timestamp").eqNullSafe(F.col("_newest"))
    order = Window.partitionBy("tool_name").orderBy(F.desc("id"), F.desc("error_msg"))
    return (
        errors.join(newest, same)
        .withColumn("_place", F.row_number().over(order))
        .where("_place = 1")
        .select("tool_name", "timestamp", "error_msg")
    )


def newest_errors(errors: DataFrame) -> DataFrame:
    """The same in one aggregation, so that a stream can keep it as its state.

    ``max`` of a struct keeps one candidate per tool and task before the
    shuffle, so a tool with most of the errors costs no more than another.
    """
    newest = F.max(F.struct("timestamp", "id", "error_msg"))
    return (
        errors.groupBy("tool_name")
        .agg(newest.alias("newest"))
        .select("tool_name", "newest.timestamp", "newest.error_msg")
    )
