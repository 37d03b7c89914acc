"""Agents kept as rows: their tools, token names, prefixes and ordered model rules.

A further agent is then some more rows, without a change of code. The rows are
applied to the distinct names of a report: tools and token names by equal
names, prefixes and model rules by a join on ``startswith`` and ``contains``,
of whose matches the first by priority counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill import files
from telemill.fixed_values import AGENTS, VERSION_AT_END, VERSION_INSIDE, Agent
from telemill.functions.names import cut_name
from telemill.session import prepare_session

# ``place`` counts on over all agents, in their order: the lowest that matches counts.
SCHEMAS = {
    "agents": "place int, agent string, agent_name string",
    "tools": "place int, agent string, tool_name string",
    "token_types": "place int, agent string, token_type string, token_class string",
    "prefixes": "place int, agent string, prefix string",
    "model_rules": "place int, agent string, short string, versioned boolean, all_of array<string>, any_of array<string>",
    "version_marks": "place int, mark string, version string, at_end boolean",
}
# Rows of rules that are broadcast at once; more are applied in several turns.
ROWS_AT_ONCE = 10_000


def _rows_of(agents: Sequence[Agent]) -> dict[str, list[tuple]]:
    found = {
        "agents": [(a.id, a.name) for a in agents],
        "tools": [(a.id, tool) for a in agents for tool in a.tools],
        "token_types": [(a.id, name, kind) for a in agents for name, kind in a.token_types.items()],
        "prefixes": [(a.id, a.metric_prefix) for a in agents],
        "model_rules": [
            (a.id, r.short, r.versioned, list(r.all_of), list(r.any_of)) for a in agents for r in a.model_rules
        ],
        "version_marks": [(*mark, False) for mark in VERSION_INSIDE] + [(*mark, True) for mark in VERSION_AT_END],
    }
    return {name: [(place, *row) for place, row in enumerate(rows)] for name, rows in found.items()}


def write_agents(spark: SparkSession, root: str, agents: Sequence[Agent] = AGENTS) -> None:
    """Keep agents, in order of priority, as the agents of a table set; readers see all of them at once."""
    rows = {name: spark.createDataFrame(some, SCHEMAS[name]) for name, some in _rows_of(agents).items()}
    write_agent_rows(rows, root)


def write_agent_rows(rows: dict[str, DataFrame], root: str) -> None:
    """The same from rows that come from elsewhere, one frame for each of ``SCHEMAS``."""
    spark = prepare_session(next(iter(rows.values())).sparkSession)
    version, counts = uuid.uuid4().hex, {}
    for name, schema in SCHEMAS.items():
        folder = f"{root}/_agents/{version}/{name}"
        rows[name].to(spark.createDataFrame([], schema).schema).write.parquet(folder)
        counts[name] = spark.read.schema(schema).parquet(folder).count()
    files.write_whole(spark, f"{root}/_agents/current", json.dumps({"version": version, "rows": counts}), replace=True)


@dataclass
class AgentTables:
    """The stored agents, and how many rows each of their tables has."""

    frames: dict[str, DataFrame]
    rows: dict[str, int]

    def blocks(self, name: str) -> Iterator[DataFrame]:
        """A table in blocks that are small enough to broadcast, which their rows' count has shown."""
        for start in range(0, max(self.rows[name], 1), ROWS_AT_ONCE):
            some = self.frames[name]
            if self.rows[name] > ROWS_AT_ONCE:
                some = some.where(F.col("place").between(start, start + ROWS_AT_ONCE - 1))
            yield F.broadcast(some)


def read_agents(spark: SparkSession, root: str) -> AgentTables:
    current = json.loads(files.read_text(prepare_session(spark), f"{root}/_agents/current"))
    folder = f"{root}/_agents/{current['version']}"
    frames = {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in SCHEMAS.items()}
    return AgentTables(frames, current["rows"])


def _first(names: DataFrame, key: str, known: AgentTables, table: str, matches: Column, result: Sequence[str]) -> DataFrame:
    """For each name that some row matches, columns of the row of the lowest place."""
    turns = None
    for block in known.blocks(table):
        found = names.join(block, matches).select(key, "place", *result)
        turns = found if turns is None else turns.unionByName(found)
    first = F.min_by(F.struct(*result), "place").alias("first")
    return turns.groupBy(key).agg(first).select(key, "first.*")


def _distinct(table: DataFrame, column: str) -> DataFrame:
    return table.select(column).where(F.col(column).isNotNull()).distinct()


def with_agent_name(table: DataFrame, known: AgentTables) -> DataFrame:
    """Add the display name of the agent in column ``agent``."""
    return table.join(known.frames["agents"].select("agent", "agent_name"), "agent", "left")


def with_tool_agent(table: DataFrame, known: AgentTables) -> DataFrame:
    """Add the first agent that lists the tool in column ``tool_name``."""
    owners = known.frames["tools"].groupBy("tool_name").agg(F.min_by("agent", "place").alias("agent"))
    return table.join(owners, "tool_name", "left")


def with_token_class(table: DataFrame, known: AgentTables) -> DataFrame:
    """Add the class of the token type in column ``token_type``, and the first agent that names it."""
    first = F.min_by(F.struct("agent", "token_class"), "place").alias("first")
    classes = known.frames["token_types"].groupBy("token_type").agg(first).select("token_type", "first.*")
    return table.join(classes, "token_type", "left")


def with_prefix_agent(table: DataFrame, known: AgentTables, column: str = "event_name") -> DataFrame:
    """Add the first agent whose prefix starts the metric or event name in a column."""
    starts = F.startswith(F.col(column), F.col("prefix"))
    found = _first(_distinct(table, column), column, known, "prefixes", starts, ["agent"])
    return table.join(found, column, "left")


def with_model_names(table: DataFrame, known: AgentTables) -> DataFrame:
    """Add short name and agent of the model in column ``model``; see ``functions.names.with_model_names``."""
    models = _distinct(table, "model").withColumn("_lowered", F.lower("model"))
    inside = lambda part: F.contains(F.col("_lowered"), part)
    holds = F.forall("all_of", inside) & ((F.size("any_of") == 0) | F.exists("any_of", inside))
    rules = _first(models, "model", known, "model_rules", holds, ["agent", "short", "versioned"])
    marked = F.when(F.col("at_end"), F.endswith(F.col("_lowered"), F.col("mark"))).otherwise(inside(F.col("mark")))
    versions = _first(models, "model", known, "version_marks", marked, ["version"])
    # concat_ws leaves out a missing version together with its dash.
    short = F.when(F.col("versioned"), F.concat_ws("-", "short", "version")).otherwise(F.col("short"))
    named = rules.join(versions, "model", "left").select("model", "agent", short.alias("_short"))
    return (
        table.join(named, "model", "left")
        .withColumn("short_model", F.when(F.col("model").isNotNull(), F.coalesce("_short", cut_name(F.col("model")))))
        .drop("_short")
    )
