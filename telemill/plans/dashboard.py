"""All reports of one range over a table set, as a screen would show them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.fixed_values import AGENTS, Agent
from telemill.functions.time_ranges import since_for
from telemill.operators import agents as agent_reports
from telemill.operators import api, events, ordering, partials, tools, usage
from telemill.session import stored
from telemill.sources import tables
from telemill.sources.commits import read_commits


def dashboard(
    spark: SparkSession,
    root: str,
    as_of: datetime,
    range_name: str = "all_time",
    sort_by: str = "calls",
    agents: Sequence[Agent] = AGENTS,
) -> dict[str, DataFrame]:
    """The reports by name, all of one moment of the tables.

    Tool calls and API events are read once each, into a row per tool and a row
    per model that are written down; what is shown of them is derived from
    these. The last error of a tool may be older than the range, as long as the
    tool has errors within it; everything else is limited to the range.
    """
    since, committed = since_for(range_name, as_of), read_commits(spark, root)
    logs, legacy, tokens, costs, sessions = (
        tables.read(spark, root, name, committed=committed)
        for name in ("log_events", "tool_events", "token_usage", "cost_usage", "session_metrics")
    )
    calls = events.unified_tool_events(legacy, logs, since)
    by_tool = stored(tools.tool_metrics(calls, F.min("timestamp").alias("first_seen")), "by-tool")
    by_model = stored(api.model_report(logs, since), "by-model")
    report = tools.with_age(tools.with_rates(by_tool.drop("first_seen")), as_of)
    models = partials.merged_api_by_model(by_model).where(F.col("model").isNotNull())
    return {
        "tools": ordering.rank_tools(tools.with_tool_class(report, agents), sort_by),
        "tool_totals": tools.tool_totals(report),
        "last_errors": tools.with_last_error(report, events.tool_errors(legacy, logs)),
        "tokens": usage.token_totals(tokens, costs, since, agents),
        "session": usage.productivity(usage.session_metrics(sessions, since)),
        "api": partials.merged_api_totals(by_model),
        "models": api.most_called(models, agents=agents),
        "agents": agent_reports.detected_agents(
            by_tool.withColumnRenamed("first_seen", "timestamp"),
            by_model.where("call_count > 0").withColumnRenamed("first_seen", "timestamp"),
            agents,
        ),
    }


# What a refresh shows of each report: the column that names the row, numbers, and texts.
SHOWN = {
    "tools": (
        "tool_name",
        [
            "call_count",
            "avg_duration_ms",
            "min_duration_ms",
            "max_duration_ms",
            "success_count",
            "error_count",
            "approved_count",
            "rejected_count",
            "bad_duration_count",
            "approval_rate",
            "success_rate",
            "age_seconds",
            "is_active",
            "is_builtin",
        ],
        ["agent"],
    ),
    "tool_totals": (None, ["tools", "total_calls", "total_errors"], []),
    "last_errors": ("tool_name", [], ["last_error"]),
    "tokens": (
        None,
        [
            "input_tokens",
            "output_tokens",
            "cache_read_tokens",
            "cache_write_tokens",
            "total_tokens",
            "total_cost_usd",
            "cache_reuse_rate",
        ],
        ["cache_reuse_band"],
    ),
    "session": (None, ["lines_of_code", "commit_count", "active_time_secs", "lines_per_hour"], []),
    "api": (None, ["total_calls", "total_errors", "avg_latency_ms"], []),
    "models": ("model", ["calls"], ["short_model"]),
    "agents": ("agent", ["position"], ["agent_name"]),
}


def refresh(reports: dict[str, DataFrame]) -> DataFrame:
    """All reports in one table: ``report, item, measure, value, text``, a row for each number and text that is there."""
    parts = []
    for name, (key, numbers, texts) in SHOWN.items():
        cells = [
            F.struct(
                F.lit(column).alias("measure"),
                (F.col(column).cast("double") if column in numbers else F.lit(None).cast("double")).alias("value"),
                (F.col(column) if column in texts else F.lit(None).cast("string")).alias("text"),
            )
            for column in (*numbers, *texts)
        ]
        item = F.col(key) if key else F.lit(None).cast("string")
        rows = reports[name].select(
            F.lit(name).alias("report"), item.alias("item"), F.explode(F.array(*cells)).alias("cell")
        )
        parts.append(rows.select("report", "item", "cell.*").where("value IS NOT NULL OR text IS NOT NULL"))
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first
