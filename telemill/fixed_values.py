"""Names, patterns and rules that results depend on.

Everything in this module is a fixed value: the names agents emit in their
telemetry, and the labels reports give them. Order matters where noted. A
further agent is one more ``Agent`` passed to the functions that take
``agents=``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# -- fixed values: event families, by the ending of the event name -----------
# LIKE patterns, so each underscore also matches any one character.
EVENT_FAMILIES = {
    "tool_result": "%tool_result",
    "api_request": "%api_request",
    "api_error": "%api_error",
}

# -- fixed values: attribute keys read at query time -------------------------
QUERY_ATTRIBUTES = (
    "tool_name",
    "success",
    "duration_ms",
    "decision",
    "error",
    "model",
    "latency_ms",
)
EVENT_NAME_KEY = "event.name"
TOKEN_TYPE_KEY = "type"
UNKNOWN = "unknown"
TRUE_TEXTS = ("true", "1")
APPROVING_DECISIONS = ("approved", "auto_approved")
REJECTING_DECISIONS = ("rejected",)

# -- fixed values: metric names ----------------------------------------------
TOKEN_METRIC = "claude_code.token.usage"
COST_METRIC = "claude_code.cost.usage"
SESSION_METRICS = (
    "claude_code.lines_of_code.count",
    "claude_code.commit.count",
    "claude_code.pull_request.count",
    "claude_code.active_time.total",
)
SESSION_METRIC_PREFIX = "claude_code."
METRIC_NAME_NOISE = ("claude_code.", ".count", ".total")

# -- fixed values: session report columns and the names that feed them -------
# The first name present wins.
SESSION_COLUMNS = {
    "lines_of_code": ("lines_of_code", "loc"),
    "commit_count": ("commits", "commit_count"),
    "active_time_secs": ("active_time",),
}

# -- fixed values: token classes ---------------------------------------------
TOKEN_CLASSES = ("input", "output", "cache_read", "cache_write")

# -- fixed values: MCP tool names, mcp__[plugin_<plugin>_]<server>__<tool> ----
# (?U) Unicode word characters, (?d) only \n ends a line, \z end of text.
MCP_NAME_PATTERN = r"(?Ud)^mcp__(?:plugin_\w+_)?(\w+)__(.+)\z"

# -- fixed values: named time ranges, label and length in hours ---------------
TIME_RANGES = {
    "last_hour": ("Last 1h", 1),
    "last_day": ("Last 24h", 24),
    "last_week": ("Last 7d", 168),
    "all_time": ("All-time", None),
}
RETENTION_DAYS = 7

# -- fixed values: report thresholds -----------------------------------------
ACTIVE_WITHIN_SECONDS = 2
FREQUENCY_STEPS = 10
TOP_MODELS = 3
SHORT_NAME_BYTES = 12
# (good above, warn above); approval counts the bound itself as reached.
CACHE_REUSE_BANDS = (50.0, 80.0)
SUCCESS_BANDS = (80.0, 95.0)
APPROVAL_BANDS = (80.0, 95.0)

# -- fixed values: version marks inside a model name, first match wins --------
VERSION_INSIDE = (
    ("-4.5-", "4.5"),
    ("-4-5-", "4.5"),
    ("-4-", "4"),
    ("-3.5-", "3.5"),
    ("-3-5-", "3.5"),
    ("-3-", "3"),
    ("-5-", "5"),
)
VERSION_AT_END = (("-4", "4"), ("-5", "5"), ("-3", "3"))


@dataclass(frozen=True)
class ModelRule:
    """A model name holding all of ``all_of`` and one of ``any_of`` is ``short``.

    ``versioned`` appends the version mark found in the name, if there is one.
    """

    short: str
    any_of: tuple[str, ...] = ()
    all_of: tuple[str, ...] = ()
    versioned: bool = False


@dataclass(frozen=True)
class Agent:
    """One coding agent: how to recognise its tools, tokens, models, metrics."""

    id: str
    name: str
    metric_prefix: str
    tools: tuple[str, ...] = ()
    token_types: dict[str, str] = field(default_factory=dict)
    model_rules: tuple[ModelRule, ...] = ()


# -- fixed values: the known agents; earlier ones win ties --------------------
CLAUDE_CODE = Agent(
    id="claude_code",
    name="Claude Code",
    metric_prefix="claude_code",
    tools=(
        "Read",
        "Write",
        "Edit",
        "Bash",
        "Glob",
        "Grep",
        "Task",
        "TodoRead",
        "TodoWrite",
        "WebFetch",
        "WebSearch",
        "Agent",
        "Skill",
        "AskUser",
        "AskUserQuestion",
        "MultiEdit",
        "NotebookEdit",
        "KillShell",
        "EnterPlanMode",
        "ExitPlanMode",
        "TaskOutput",
    ),
    token_types={
        "input": "input",
        "input_tokens": "input",
        "output": "output",
        "output_tokens": "output",
        "cacheRead": "cache_read",
        "cache_read": "cache_read",
        "cache_hit": "cache_read",
        "cacheCreation": "cache_write",
        "cache_creation": "cache_write",
        "cache_write": "cache_write",
    },
    model_rules=(
        ModelRule("opus-4.5", all_of=("opus",), any_of=("4.5", "4-5")),
        ModelRule("opus", all_of=("opus",), versioned=True),
        ModelRule("sonnet", all_of=("sonnet",), versioned=True),
        ModelRule("haiku", all_of=("haiku",), versioned=True),
    ),
)

OPENAI_CODEX = Agent(
    id="openai_codex",
    name="OpenAI Codex",
    metric_prefix="codex",
    tools=(
        "shell",
        "read_file",
        "write_file",
        "edit_file",
        "search",
        "list_files",
        "run_command",
        "apply_patch",
    ),
    token_types={"prompt_tokens": "input", "completion_tokens": "output"},
    model_rules=(
        ModelRule("gpt-4o", any_of=("gpt-4o",)),
        ModelRule("gpt-4-turbo", any_of=("gpt-4-turbo",)),
        ModelRule("gpt-4", any_of=("gpt-4",)),
        ModelRule("gpt-3.5", any_of=("gpt-3.5", "gpt-3")),
        ModelRule("o1-preview", any_of=("o1-preview",)),
        ModelRule("o1-mini", any_of=("o1-mini",)),
        ModelRule("o1", any_of=("o1",)),
        ModelRule("o3-mini", any_of=("o3-mini",)),
        ModelRule("o3", any_of=("o3",)),
    ),
)

GEMINI_CLI = Agent(
    id="gemini_cli",
    name="Gemini CLI",
    metric_prefix="gemini_cli",
    tools=(
        "read_file",
        "write_file",
        "edit_file",
        "run_shell_command",
        "search_files",
        "list_directory",
        "find_files",
        "glob_files",
        "web_search",
        "memory_tool",
    ),
    token_types={
        "input": "input",
        "prompt": "input",
        "input_tokens": "input",
        "prompt_tokens": "input",
        "output": "output",
        "completion": "output",
        "output_tokens": "output",
        "completion_tokens": "output",
    },
    model_rules=(
        ModelRule("gemini-2.0-flash", any_of=("gemini-2.0", "gemini-2-"), all_of=("flash",)),
        ModelRule("gemini-2.0-pro", any_of=("gemini-2.0", "gemini-2-"), all_of=("pro",)),
        ModelRule("gemini-2.0", any_of=("gemini-2.0", "gemini-2-")),
        ModelRule("gemini-2", any_of=("gemini-2",)),
        ModelRule("gemini-1.5-pro", any_of=("gemini-1.5-pro", "gemini-1-5-pro")),
        ModelRule("gemini-1.5-flash", any_of=("gemini-1.5-flash", "gemini-1-5-flash")),
        ModelRule("gemini-1.5", any_of=("gemini-1.5",)),
        ModelRule("gemini-1.0", any_of=("gemini-1.0", "gemini-pro")),
        ModelRule("gemini", any_of=("gemini",)),
    ),
)

QWEN_CODE = Agent(
    id="qwen_code",
    name="Qwen Code",
    metric_prefix="qwen-code",
    tools=(
        "read_file",
        "write_file",
        "edit_file",
        "run_command",
        "search",
        "list_files",
        "create_file",
        "delete_file",
    ),
    token_types={
        "input": "input",
        "input_tokens": "input",
        "output": "output",
        "output_tokens": "output",
        "cache": "cache_read",
        "cache_tokens": "cache_read",
    },
    model_rules=(
        ModelRule("qwen-2.5-coder", any_of=("2.5", "2-5"), all_of=("qwen", "coder")),
        ModelRule("qwen-2.5", any_of=("2.5", "2-5"), all_of=("qwen",)),
        ModelRule("qwen-2-coder", any_of=("qwen2", "qwen-2"), all_of=("coder",)),
        ModelRule("qwen-2", any_of=("qwen2", "qwen-2")),
        ModelRule("qwen-1.5", any_of=("1.5", "1-5"), all_of=("qwen",)),
        ModelRule("qwen", any_of=("qwen",)),
    ),
)

AGENTS = (CLAUDE_CODE, OPENAI_CODEX, GEMINI_CLI, QWEN_CODE)
