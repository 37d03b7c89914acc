"""Tool, metric and model names turned into what reports show."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.fixed_values import (
    AGENTS,
    MCP_NAME_PATTERN,
    METRIC_NAME_NOISE,
    SHORT_NAME_BYTES,
    VERSION_AT_END,
    VERSION_INSIDE,
    Agent,
    ModelRule,
)
from telemill.functions import sql_text


def _mcp_part(name: Column, group: int) -> Column:
    # Both parts are non-empty in every match, so '' means no match.
    return F.nullif(F.regexp_extract(name, MCP_NAME_PATTERN, group), F.lit(""))


def mcp_server(name: Column) -> Column:
    """Server of an MCP tool name, NULL for other names."""
    return _mcp_part(name, 1)


def mcp_tool(name: Column) -> Column:
    """Tool of an MCP tool name, NULL for other names."""
    return _mcp_part(name, 2)


def display_name(name: Column) -> Column:
    """``server:tool`` for MCP tool names, other names as they are."""
    return F.coalesce(F.concat(mcp_server(name), F.lit(":"), mcp_tool(name)), name)


def metric_base_name(name: Column) -> Column:
    """Metric name without its prefix and its unit endings."""
    for noise in METRIC_NAME_NOISE:
        name = F.replace(name, F.lit(noise), F.lit(""))
    return name


def metric_agent(column: str, agents: Sequence[Agent] = AGENTS) -> Column:
    """Id of the first agent whose prefix starts the metric or event name in a column."""
    return F.expr(
        sql_text.first_match(
            (
                f"startswith({sql_text.name(column)}, {sql_text.literal(agent.metric_prefix)})",
                sql_text.literal(agent.id),
            )
            for agent in agents
        )
    )


def _contains(lowered: str, part: str) -> str:
    return f"contains({lowered}, {sql_text.literal(part)})"


def _rule_holds(lowered: str, rule: ModelRule) -> str:
    needed = [_contains(lowered, part) for part in rule.all_of]
    if rule.any_of:
        needed.append("(" + " OR ".join(_contains(lowered, part) for part in rule.any_of) + ")")
    return " AND ".join(needed)


def _model_version(lowered: str) -> str:
    inside = [(_contains(lowered, mark), sql_text.literal(v)) for mark, v in VERSION_INSIDE]
    ending = [
        (f"endswith({lowered}, {sql_text.literal(mark)})", sql_text.literal(version))
        for mark, version in VERSION_AT_END
    ]
    return sql_text.first_match(inside + ending)


def _short_label(lowered: str, rule: ModelRule) -> str:
    label = sql_text.literal(rule.short)
    # concat_ws leaves out a missing version together with its dash.
    return f"concat_ws('-', {label}, {_model_version(lowered)})" if rule.versioned else label


def cut_name(name: Column) -> Column:
    """The beginning of a long name."""
    # A cut inside a character moves back to the character's start.
    encoded = F.encode(name, "UTF-8")
    prefixes = [
        F.try_validate_utf8(F.substring(encoded, 1, SHORT_NAME_BYTES - back).cast("string"))
        for back in range(4)
    ]
    return F.when(
        F.octet_length(name) > SHORT_NAME_BYTES, F.concat(F.coalesce(*prefixes), F.lit("..."))
    ).otherwise(name)


def with_model_names(table: DataFrame, agents: Sequence[Agent] = AGENTS) -> DataFrame:
    """Add short name and agent of the model in column ``model``.

    The first rule that holds, in the order of the agents, gives both. Without
    one there is no agent and the short name is the beginning of the name.
    """
    lowered = "_lowered_model"
    rules = [(agent, rule) for agent in agents for rule in agent.model_rules]
    agent = sql_text.first_match(
        (_rule_holds(lowered, rule), sql_text.literal(agent.id)) for agent, rule in rules
    )
    short = sql_text.first_match(
        (_rule_holds(lowered, rule), _short_label(lowered, rule)) for _, rule in rules
    )
    model = F.col("model")
    # The lower-case name is a column of its own, so it is computed once.
    return (
        table.withColumn(lowered, F.lower(model))
        .withColumns(
            {
                "short_model": F.when(
                    model.isNotNull(), F.coalesce(F.expr(short), cut_name(model))
                ),
                "agent": F.expr(agent),
            }
        )
        .drop(lowered)
    )
