"""Agents from rows against agents of the plan."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from telemill.fixed_values import AGENTS, VERSION_AT_END, VERSION_INSIDE, Agent, ModelRule
from telemill.functions import names
from telemill.functions.names import metric_agent
from telemill.sources import agent_tables
from telemill.sources.agents import agent_dim, token_type_dim, tool_dim

FIFTH = Agent(
    id="fifth",
    name="Fifth",
    metric_prefix="codex_next",  # a known prefix starts it, so the known agent comes first
    tools=("shell", "own_tool"),
    token_types={"input": "output", "reasoning": "output"},
    model_rules=(ModelRule("own", all_of=("own",), any_of=("model", "4.5"), versioned=True),),
)


def stored(spark, tmp_path, agents=AGENTS):
    agent_tables.write_agents(spark, str(tmp_path), agents)
    return agent_tables.read_agents(spark, str(tmp_path))


def model_names():
    """Names that hold each mark of each rule, alone and with each version, and some that hold none."""
    found = ["", "nothing", "a-rather-long-name-of-no-agent", "ümläut-näme-of-no-agent", "turbo1", "O3", "GPT-4O"]
    for agent in (*AGENTS, FIFTH):
        for rule in agent.model_rules:
            for some in rule.any_of or ("",):
                base = "-".join([*rule.all_of, some]).strip("-")
                found += [base, base.upper(), f"x{base}y", f"{base}-latest"]
                found += [f"{base}{mark}2025" for mark, _ in VERSION_INSIDE]
                found += [f"{base}{mark}" for mark, _ in VERSION_AT_END]
    return sorted(set(found))


@pytest.mark.parametrize("agents", [AGENTS, (*AGENTS, FIFTH), (FIFTH, *AGENTS)])
def test_models_equal_those_of_the_plan(spark, tmp_path, agents):
    rows = [(name,) for name in [*model_names(), None]]
    models = spark.createDataFrame(rows, "model string")
    got = agent_tables.with_model_names(models, stored(spark, tmp_path, agents)).select("model", "short_model", "agent")
    want = names.with_model_names(models, agents).select("model", "short_model", "agent")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_tools_tokens_and_prefixes_equal_those_of_the_plan(spark, tmp_path):
    agents = (*AGENTS, FIFTH)
    known = stored(spark, tmp_path, agents)
    tools = spark.createDataFrame([(t,) for a in agents for t in a.tools] + [("none",), (None,)], "tool_name string")
    tools = tools.distinct()
    got, want = agent_tables.with_tool_agent(tools, known), tools.join(tool_dim(spark, agents), "tool_name", "left")
    assert got.select(*want.columns).exceptAll(want).count() == 0 == want.exceptAll(got.select(*want.columns)).count()
    tokens = spark.createDataFrame([(t,) for a in agents for t in a.token_types] + [("none",)], "token_type string")
    got = agent_tables.with_token_class(tokens, known).select("token_type", "token_class")
    want = tokens.join(token_type_dim(spark, agents), "token_type", "left")
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    events = [f"{a.metric_prefix}.x" for a in agents] + ["codex_next", "cod", "x.codex", None]
    events = spark.createDataFrame([(e,) for e in events], "event_name string")
    got = agent_tables.with_prefix_agent(events, known).select("event_name", "agent")
    want = events.select("event_name", metric_agent("event_name", agents).alias("agent"))
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    shown = agent_tables.with_agent_name(spark.createDataFrame([("fifth",), ("no",)], "agent string"), known)
    assert {r.agent: r.agent_name for r in shown.collect()} == {"fifth": "Fifth", "no": None}
    dim = agent_dim(spark, agents).select("agent", "agent_name")
    assert known.frames["agents"].select("agent", "agent_name").exceptAll(dim).count() == 0


def test_many_rules_go_in_turns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(agent_tables, "ROWS_AT_ONCE", 5)
    models = spark.createDataFrame([(name,) for name in model_names()], "model string")
    got = agent_tables.with_model_names(models, stored(spark, tmp_path)).select("model", "short_model", "agent")
    want = names.with_model_names(models).select("model", "short_model", "agent")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_names_are_matched_once_whatever_their_rows(spark, tmp_path):
    known = stored(spark, tmp_path)
    models = spark.range(1000).select(F.lit("gpt-4o").alias("model"))
    named = agent_tables.with_model_names(models, known)
    assert named.where("agent = 'openai_codex' and short_model = 'gpt-4o'").count() == 1000
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "Cartesian" not in plan


def test_new_agents_replace_old_ones_whole(spark, tmp_path):
    old = stored(spark, tmp_path)
    new = stored(spark, tmp_path, (FIFTH,))
    tools = spark.createDataFrame([("shell",)], "tool_name string")
    assert agent_tables.with_tool_agent(tools, new).first().agent == "fifth"
    assert agent_tables.with_tool_agent(tools, old).first().agent == "openai_codex"
    assert new.rows["tools"] == 2


def test_no_agents_and_no_names(spark, tmp_path):
    known = stored(spark, tmp_path, ())
    models = spark.createDataFrame([("gpt-4o",), (None,)], "model string")
    got = {r.model: (r.short_model, r.agent) for r in agent_tables.with_model_names(models, known).collect()}
    assert got == {"gpt-4o": ("gpt-4o", None), None: (None, None)}
    assert agent_tables.with_model_names(models.limit(0), known).count() == 0
