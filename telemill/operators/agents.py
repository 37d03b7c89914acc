"""Which agents are at work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.fixed_values import AGENTS, Agent
from telemill.functions import attributes as A
from telemill.functions import names
from telemill.sources.agents import agent_dim, tool_dim


def detected_agents(
    events: DataFrame, requests: DataFrame, agents: Sequence[Agent] = AGENTS
) -> DataFrame:
    """Agents seen through their tools or models, in order of first sight.

    ``events`` are unified tool calls and ``requests`` API requests, both
    already limited in time. Each is reduced to its distinct tools or models
    before names are looked up.
    """
    spark = events.sparkSession
    by_tool = (
        events.groupBy("tool_name")
        .agg(F.min("timestamp").alias("first_seen"))
        .join(tool_dim(spark, agents), "tool_name")
        .select("agent", "first_seen")
    )
    models = (
        requests.filter(F.col("model").isNotNull())
        .groupBy("model")
        .agg(F.min("timestamp").alias("first_seen"))
    )
    by_model = (
        names.with_model_names(models, agents)
        .filter(F.col("agent").isNotNull())
        .select("agent", "first_seen")
    )
    first_seen = (
        by_tool.unionByName(by_model).groupBy("agent").agg(F.min("first_seen").alias("first_seen"))
    )
    # One row per known agent, so numbering them in one task is bounded.
    order = Window.orderBy("first_seen", "priority")
    return first_seen.join(agent_dim(spark, agents), "agent").select(
        F.row_number().over(order).alias("position"), "agent", "agent_name", "first_seen"
    )


def telling_names(logs: DataFrame) -> DataFrame:
    """Time, tool and model of every log event that may give an agent away; one of the two names is NULL."""
    tool_result = A.is_family(logs, "tool_result")
    request = A.is_family(logs, "api_request")
    named = logs.filter(tool_result | request).select(
        "timestamp",
        F.when(tool_result, A.attribute(logs, "tool_name")).alias("tool_name"),
        F.when(request, A.attribute(logs, "model")).alias("model"),
    )
    return named.filter(F.col("tool_name").isNotNull() | F.col("model").isNotNull())


def agents_of_names(rows: DataFrame, agents: Sequence[Agent] = AGENTS) -> DataFrame:
    """The agent of each row's model or, failing that, tool, in place of both; rows without one go."""
    by_model = names.with_model_names(rows, agents).withColumnRenamed("agent", "model_agent")
    dim = tool_dim(rows.sparkSession, agents)
    return (
        by_model.join(dim, "tool_name", "left")
        .withColumn("agent", F.coalesce("model_agent", "agent"))
        .filter(F.col("agent").isNotNull())
        .drop("tool_name", "model", "short_model", "model_agent")
    )


def agent_sightings(logs: DataFrame, agents: Sequence[Agent] = AGENTS) -> DataFrame:
    """Agent and time of every log event that gives an agent away."""
    return agents_of_names(telling_names(logs), agents).select("agent", "timestamp")


def events_by_prefix_agent(logs: DataFrame, agents: Sequence[Agent] = AGENTS) -> DataFrame:
    """Events per agent, by the prefix of the event name."""
    return (
        logs.groupBy("event_name")
        .agg(F.count("*").alias("events"))
        .groupBy(names.metric_agent("event_name", agents).alias("agent"))
        .agg(F.sum("events").alias("events"))
    )
