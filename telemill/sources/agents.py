"""Small dimension frames of the known agents.

They are literal rows of the plan, so Catalyst knows their exact size and
broadcasts them by its own threshold; a list of agents grown past it is joined
by shuffle instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from telemill.fixed_values import AGENTS, Agent
from telemill.functions import sql_text


def _literal_rows(spark: SparkSession, rows: Iterable[tuple], columns: dict[str, str]) -> DataFrame:
    tuples = ["(" + ", ".join(sql_text.literal(value) for value in row) + ")" for row in rows]
    if not tuples:
        return spark.createDataFrame([], ", ".join(f"{name} {kind}" for name, kind in columns.items()))
    return spark.sql(f"SELECT * FROM VALUES {', '.join(tuples)} AS t({', '.join(columns)})")


def agent_dim(spark: SparkSession, agents: Sequence[Agent] = AGENTS) -> DataFrame:
    """One row per agent: id, display name, metric prefix and priority."""
    return _literal_rows(
        spark,
        [(agent.id, agent.name, agent.metric_prefix, place) for place, agent in enumerate(agents)],
        {"agent": "string", "agent_name": "string", "metric_prefix": "string", "priority": "int"},
    )


def tool_dim(spark: SparkSession, agents: Sequence[Agent] = AGENTS) -> DataFrame:
    """One row per built-in tool, with the first agent that lists it."""
    owner: dict[str, str] = {}
    for agent in agents:
        for tool in agent.tools:
            owner.setdefault(tool, agent.id)
    return _literal_rows(spark, owner.items(), {"tool_name": "string", "agent": "string"})


def token_type_dim(spark: SparkSession, agents: Sequence[Agent] = AGENTS) -> DataFrame:
    """One row per known token type, with the first agent's class for it."""
    classes: dict[str, str] = {}
    for agent in agents:
        for token_type, token_class in agent.token_types.items():
            classes.setdefault(token_type, token_class)
    return _literal_rows(spark, classes.items(), {"token_type": "string", "token_class": "string"})
