from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from telemill.fixed_values import AGENTS, Agent, ModelRule
from telemill.functions import names
from telemill.sources.agents import agent_dim, token_type_dim, tool_dim

MCP_NAMES = {
    "mcp__context7__resolve-library-id": ("context7", "resolve-library-id"),
    "mcp__context7__query-docs": ("context7", "query-docs"),
    "mcp__plugin_foo_myserver__my-tool": ("myserver", "my-tool"),
    "mcp__a__b__c": ("a__b", "c"),
    "mcp__größe__werkzeug": ("größe", "werkzeug"),
    "mcp__s__tool\nnext": (None, None),
    "mcp__s__tool\rnext": ("s", "tool\rnext"),
    "Read": (None, None),
    "mcp_tool": (None, None),
    "mcp__server": (None, None),
    "mcp__": (None, None),
    "xmcp__a__b": (None, None),
}


def test_mcp_names(spark):
    frame = spark.createDataFrame([(name,) for name in MCP_NAMES], "name string")
    found = {
        row.name: (row.server, row.tool, row.shown)
        for row in frame.select(
            "name",
            names.mcp_server(F.col("name")).alias("server"),
            names.mcp_tool(F.col("name")).alias("tool"),
            names.display_name(F.col("name")).alias("shown"),
        ).collect()
    }
    for name, (server, tool) in MCP_NAMES.items():
        assert found[name] == (server, tool, f"{server}:{tool}" if server else name)


MODELS = {
    "claude-opus-4-5-20250514": ("opus-4.5", "claude_code"),
    "claude-opus-4-20250514": ("opus-4", "claude_code"),
    "Claude-Opus-4.5": ("opus-4.5", "claude_code"),
    "opus": ("opus", "claude_code"),
    "claude-sonnet-4-20250514": ("sonnet-4", "claude_code"),
    "claude-sonnet-4-5": ("sonnet-4", "claude_code"),
    "claude-sonnet-4-5-20250929": ("sonnet-4.5", "claude_code"),
    "claude-3-5-sonnet-20241022": ("sonnet-3.5", "claude_code"),
    "claude-sonnet-4": ("sonnet-4", "claude_code"),
    "claude-3-5-haiku-20241022": ("haiku-3.5", "claude_code"),
    "claude-haiku-3-20240307": ("haiku-3", "claude_code"),
    "claude-3-haiku": ("haiku-3", "claude_code"),
    "gpt-4o-2024-05-13": ("gpt-4o", "openai_codex"),
    "gpt-4o-mini": ("gpt-4o", "openai_codex"),
    "gpt-4-turbo-preview": ("gpt-4-turbo", "openai_codex"),
    "gpt-4-0613": ("gpt-4", "openai_codex"),
    "gpt-3.5-turbo": ("gpt-3.5", "openai_codex"),
    "o1-preview": ("o1-preview", "openai_codex"),
    "o1-mini": ("o1-mini", "openai_codex"),
    "turbo1": ("o1", "openai_codex"),
    "o3-mini": ("o3-mini", "openai_codex"),
    "o3": ("o3", "openai_codex"),
    "gemini-2.0-flash-exp": ("gemini-2.0-flash", "gemini_cli"),
    "gemini-2.0-pro": ("gemini-2.0-pro", "gemini_cli"),
    "gemini-2-ultra": ("gemini-2.0", "gemini_cli"),
    "gemini-2": ("gemini-2", "gemini_cli"),
    "gemini-2.5-pro": ("gemini-2", "gemini_cli"),
    "gemini-1.5-pro-latest": ("gemini-1.5-pro", "gemini_cli"),
    "gemini-1.5-flash-001": ("gemini-1.5-flash", "gemini_cli"),
    "gemini-1.5-x": ("gemini-1.5", "gemini_cli"),
    "gemini-pro": ("gemini-1.0", "gemini_cli"),
    "gemini-exp": ("gemini", "gemini_cli"),
    "qwen2.5-coder-32b-instruct": ("qwen-2.5-coder", "qwen_code"),
    "qwen-2.5-72b": ("qwen-2.5", "qwen_code"),
    "qwen2-72b-instruct": ("qwen-2", "qwen_code"),
    "qwen2-coder": ("qwen-2-coder", "qwen_code"),
    "qwen1.5-7b": ("qwen-1.5", "qwen_code"),
    "qwen-coder": ("qwen", "qwen_code"),
    "some-very-long-unknown-model-name": ("some-very-lo...", None),
    "short": ("short", None),
    "exactly12chr": ("exactly12chr", None),
    "ää-ää-ääxyz": ("ää-ää-ä...", None),  # the twelfth byte ends a character
    "xää-ää-ääyz": ("xää-ää-...", None),  # the twelfth byte is inside a character
}


def test_model_names(spark):
    frame = spark.createDataFrame([(name,) for name in MODELS], "model string")
    found = {
        row.model: (row.short_model, row.agent)
        for row in names.with_model_names(frame).collect()
    }
    assert found == MODELS


def test_missing_model_stays_missing(spark):
    row = names.with_model_names(spark.createDataFrame([(None,)], "model string")).first()
    assert (row.short_model, row.agent) == (None, None)


@pytest.mark.parametrize(
    "name, agent",
    [
        ("claude_code.token.usage", "claude_code"),
        ("codex.tool_result", "openai_codex"),
        ("gemini_cli.api_request", "gemini_cli"),
        ("qwen-code.tool_call", "qwen_code"),
        ("tool_result", None),
        (None, None),
    ],
)
def test_metric_agent(spark, name, agent):
    frame = spark.createDataFrame([(name,)], "name string")
    assert frame.select(names.metric_agent("name")).first()[0] == agent


def test_metric_base_name(spark):
    cases = {
        "claude_code.lines_of_code.count": "lines_of_code",
        "claude_code.active_time.total": "active_time",
        "claude_code.claude_code.x.count.total.count": "x",
        "claude_code.commit.count": "commit",
    }
    frame = spark.createDataFrame([(name,) for name in cases], "name string")
    found = {
        r.name: r.base
        for r in frame.select("name", names.metric_base_name(F.col("name")).alias("base")).collect()
    }
    assert found == cases


def test_first_agent_owns_a_shared_tool(spark):
    owners = {row.tool_name: row.agent for row in tool_dim(spark).collect()}
    for shared in ("read_file", "write_file", "edit_file", "search", "list_files", "run_command"):
        assert owners[shared] == "openai_codex"
    assert owners["Read"] == "claude_code"
    assert owners["run_shell_command"] == "gemini_cli"
    assert owners["create_file"] == "qwen_code"
    assert len(owners) == len({tool for agent in AGENTS for tool in agent.tools})


def test_token_classes(spark):
    classes = {row.token_type: row.token_class for row in token_type_dim(spark).collect()}
    assert classes == {
        "input": "input",
        "input_tokens": "input",
        "prompt_tokens": "input",
        "prompt": "input",
        "output": "output",
        "output_tokens": "output",
        "completion_tokens": "output",
        "completion": "output",
        "cacheRead": "cache_read",
        "cache_read": "cache_read",
        "cache_hit": "cache_read",
        "cache": "cache_read",
        "cache_tokens": "cache_read",
        "cacheCreation": "cache_write",
        "cache_creation": "cache_write",
        "cache_write": "cache_write",
    }


def test_further_agent(spark):
    extra = Agent(
        id="other",
        name="O'ther",
        metric_prefix="other",
        tools=("poke", "Read"),
        token_types={"fed": "input"},
        model_rules=(ModelRule("alpha", any_of=("alpha",)),),
    )
    agents = (*AGENTS, extra)
    owners = {row.tool_name: row.agent for row in tool_dim(spark, agents).collect()}
    assert owners["poke"] == "other" and owners["Read"] == "claude_code"
    assert agent_dim(spark, agents).filter("agent = 'other'").first().agent_name == "O'ther"
    frame = spark.createDataFrame([("my-ALPHA-2",)], "model string")
    row = names.with_model_names(frame, agents).first()
    assert (row.short_model, row.agent) == ("alpha", "other")
