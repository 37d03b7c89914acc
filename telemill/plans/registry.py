"""Named queries over the tables derived from the given data."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.fixed_values import AGENTS, Agent, ModelRule
from telemill.functions.names import with_model_names
from telemill.functions.time_ranges import since_for
from telemill.operators import agents, api, events, ordering, tools, usage
from telemill.plans import fixture
from telemill.plans.dashboard import dashboard, refresh
from telemill.session import new_folder
from telemill.sources import agent_tables, compaction, otlp, rollups, tables
from telemill.sources.errors import search_last_error
from telemill.streaming import ingest, live, panes

Query = Callable[[SparkSession, str], DataFrame]


# Doubles carried through unchanged, as opposed to sums and means.
_EXACT = ("amount",)


def shown(table: DataFrame) -> DataFrame:
    """Results as the check compares them: computed doubles to four places, times without a zone."""
    columns = []
    for column in table.schema.fields:
        kind = column.dataType.typeName()
        if kind == "double" and column.name not in _EXACT:
            columns.append(F.round(F.col(column.name), 4).alias(column.name))
        elif kind == "timestamp":
            columns.append(F.col(column.name).cast("timestamp_ntz").alias(column.name))
        else:
            columns.append(F.col(column.name))
    return table.select(*columns)


# An agent that the package does not know.
FURTHER_AGENT = Agent(
    id="further_agent",
    name="Further Agent",
    metric_prefix="further",
    tools=("my_custom_tool", "legacy_tool"),
    model_rules=(ModelRule("long", all_of=("very-long",)),),
)


# One that is known from stored rows only.
FIFTH_AGENT = Agent(
    id="fifth_agent",
    name="Fifth Agent",
    metric_prefix="session",
    tools=("my_custom_tool", "shell"),
    token_types={"thought": "output", "input": "output"},
    model_rules=(ModelRule("long", all_of=("very-long",)), ModelRule("r1", any_of=("deepseek",))),
)

# A moment within a minute, an hour and a day.
CUT = datetime(2024, 1, 20, 7, 31, 5, 250000)


class Telemetry:
    """The derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.base = fixture.base_events(spark, sf_dir)

    def __getattr__(self, name: str) -> DataFrame:
        return fixture.TABLES[name](self.base)

    def calls(self, range_name: str = "all_time") -> DataFrame:
        since = since_for(range_name, fixture.AS_OF)
        return events.unified_tool_events(self.tool_events, self.log_events, since)

    def metrics(self, range_name: str = "all_time") -> DataFrame:
        return tools.tool_metrics(self.calls(range_name))

    def errors(self) -> DataFrame:
        return events.tool_errors(self.tool_events, self.log_events)


def _since(range_name: str):
    return since_for(range_name, fixture.AS_OF)


def _logged_metrics(t: Telemetry) -> DataFrame:
    return tools.tool_metrics(events.logged_tool_calls(t.log_events))


def _position(by: str, ascending: bool = False) -> Callable[[Telemetry], DataFrame]:
    def query(t: Telemetry) -> DataFrame:
        report = t.metrics().select("tool_name", "call_count", "last_call", "avg_duration_ms")
        return ordering.with_position(report, ordering.sort_keys(by, ascending))

    return query


def _age_at_latest(t: Telemetry) -> DataFrame:
    """Ages at the moment of the newest call, when a tool is active."""
    report = t.metrics()
    now = report.agg(F.max("last_call")).first()[0]
    return tools.with_age(report, now).select("tool_name", "last_call", "age_seconds", "is_active")


BATCH: dict[str, Callable[[Telemetry], DataFrame]] = {
    # Tool report
    "tool_metrics": _logged_metrics,
    "tool_metrics_legacy_union": lambda t: t.metrics(),
    "tool_metrics_last_hour": lambda t: t.metrics("last_hour"),
    "tool_metrics_last_day": lambda t: t.metrics("last_day"),
    "tool_metrics_last_week": lambda t: t.metrics("last_week"),
    "tool_totals": lambda t: tools.tool_totals(t.metrics()),
    "tool_order_calls": _position("calls"),
    "tool_order_calls_ascending": _position("calls", ascending=True),
    "tool_order_last_call": _position("last_call"),
    "tool_order_avg_duration": _position("avg_duration"),
    "tool_order_name": _position("name"),
    "tool_agents": lambda t: tools.with_agent_name(tools.with_tool_class(t.metrics())).select(
        "tool_name", "call_count", "agent", "agent_name", "is_builtin"
    ),
    "tool_classes": lambda t: tools.tool_classes(t.metrics()),
    "builtin_tools": lambda t: tools.builtin_tools(t.metrics()),
    "mcp_tools": lambda t: tools.mcp_tools(t.metrics()),
    "mcp_servers": lambda t: tools.mcp_servers(t.metrics()),
    "tool_frequency": lambda t: tools.with_frequency(t.metrics()).select(
        "tool_name", "is_builtin", "call_count", "freq_ratio", "freq_tenths"
    ),
    "tool_rates": lambda t: tools.with_rates(t.metrics()).select(
        "tool_name", "approved_count", "rejected_count", "approval_rate", "success_rate"
    ),
    "tool_detail": lambda t: tools.with_last_error(
        tools.with_rates(t.metrics("last_day")), t.errors()
    ).select("tool_name", "call_count", "error_count", "success_rate", "last_error"),
    "tool_age": lambda t: tools.with_age(t.metrics(), fixture.AS_OF).select(
        "tool_name", "last_call", "age_seconds", "is_active"
    ),
    "tool_age_latest": lambda t: _age_at_latest(t),
    "tool_health_bands": lambda t: tools.health_bands(_logged_metrics(t)),
    # Errors
    "tool_errors": lambda t: t.errors(),
    "last_error_all": lambda t: events.last_errors(t.errors()),
    # Tokens, cost, session
    "tokens_by_type": lambda t: usage.tokens_by_type(t.token_usage),
    "tokens_by_class": lambda t: usage.tokens_by_class(t.token_usage),
    "token_unmatched": lambda t: usage.unmatched_tokens(t.token_usage),
    "token_totals": lambda t: usage.token_totals(t.token_usage, t.cost_usage),
    "token_totals_last_week": lambda t: usage.token_totals(
        t.token_usage, t.cost_usage, _since("last_week")
    ),
    "cost_total": lambda t: usage.cost_total(t.cost_usage),
    "session_by_name": lambda t: usage.session_by_name(t.session_metrics),
    "session_metrics": lambda t: usage.session_metrics(t.session_metrics),
    "session_metrics_last_week": lambda t: usage.session_metrics(
        t.session_metrics, _since("last_week")
    ),
    "productivity": lambda t: usage.productivity(usage.session_metrics(t.session_metrics)),
    # API
    "api_by_model": lambda t: api.api_by_model(t.log_events),
    "api_by_model_last_week": lambda t: api.api_by_model(t.log_events, _since("last_week")),
    "api_calls_per_model": lambda t: api.calls_per_model(t.log_events),
    "api_totals": lambda t: api.api_totals(t.log_events),
    "api_totals_last_day": lambda t: api.api_totals(t.log_events, _since("last_day")),
    "top_models": lambda t: api.top_models(t.log_events),
    "model_short_usage": lambda t: api.usage_by_short_model(t.log_events),
    "model_agents": lambda t: tools.with_agent_name(
        with_model_names(api.calls_per_model(t.log_events).select("model"))
    ).select("model", "short_model", "agent", "agent_name"),
    # Agents
    "detected_agents": lambda t: agents.detected_agents(t.calls(), api.api_requests(t.log_events)),
    "further_agent": lambda t: agents.detected_agents(
        t.calls(), api.api_requests(t.log_events), (*AGENTS, FURTHER_AGENT)
    ),
    "metric_prefix_agent": lambda t: agents.events_by_prefix_agent(t.log_events),
}


def _flat_log_rows(logs: DataFrame) -> DataFrame:
    """Log events as flat rows, by the id that travelled with the payload."""
    keys = [name for name in fixture.LOG_COLUMNS if name != "event_name"]
    return logs.select(
        F.col("attributes")["row_id"].cast("bigint").alias("id"),
        "timestamp",
        "event_name",
        "body",
        *[F.col("attributes")[key].alias(key) for key in keys],
    )


def _routed_rows(tokens: DataFrame, costs: DataFrame, sessions: DataFrame, *more: str) -> DataFrame:
    """The rows of the three metric tables in one shape."""
    parts = (
        tokens.selectExpr("'token_usage' as kind", "token_type as label", "count as amount", *more),
        costs.selectExpr("'cost_usage' as kind", "cast(null as string) as label", "cost_usd as amount", *more),
        sessions.selectExpr("'session_metrics' as kind", "metric_name as label", "value as amount", *more),
    )
    first, *rest = (part.withColumn("amount", F.col("amount").cast("double")) for part in parts)
    for part in rest:
        first = first.unionByName(part)
    return first


def _ingested_metrics(profile: str) -> Callable[[Telemetry], DataFrame]:
    def query(t: Telemetry) -> DataFrame:
        points, _ = otlp.parse_metrics(fixture.metric_payloads(t.base))
        return otlp.routed_points(points, profile).selectExpr(
            "table as kind",
            """case table when 'token_usage' then token_type
                 when 'session_metrics' then metric_name end as label""",
            """case table when 'token_usage' then cast(count as double)
                 when 'session_metrics' then cast(value as double) else cost_usd end as amount""",
        )

    return query


def _payload_check(t: Telemetry) -> DataFrame:
    """Requests and records per outcome."""
    rows = otlp.log_rows(fixture.damaged_log_payloads(t.base))
    return rows.groupBy("valid").agg(
        F.count_if(F.col("valid")).alias("records"),
        F.count_if(~F.col("valid")).alias("bad_payloads"),
        F.count("body").alias("bodies"),
    )


def _metric_payload_check(t: Telemetry) -> DataFrame:
    """Stored points per table, and bad payloads."""
    rows = otlp.routed_points(otlp.metric_rows(fixture.damaged_metric_payloads(t.base)))
    return rows.groupBy(F.col("table").alias("kind")).agg(F.count("*").alias("stored"))


INGEST: dict[str, Callable[[Telemetry], DataFrame]] = {
    "ingest_logs_roundtrip": lambda t: _flat_log_rows(
        otlp.parse_logs(fixture.log_payloads(t.base))[0]
    ),
    "ingest_metrics_roundtrip": _ingested_metrics("json"),
    "ingest_metrics_proto_profile": _ingested_metrics("proto"),
    "quarantine_counts": _payload_check,
    "quarantine_metric_counts": _metric_payload_check,
}


def _stored(spark: SparkSession, sf_dir: str, loads: int = 1) -> tuple[Telemetry, str]:
    """All derived tables written to a new table set, dealt over some loads."""
    t = Telemetry(spark, sf_dir)
    root = new_folder(spark, "tables")
    for load in range(loads):
        base = t.base if loads == 1 else t.base.where(F.col("id") % loads == load)
        some = {name: build(base) for name, build in fixture.TABLES.items()}
        tables.append_tables(some, root, f"load-{load}")
    return t, root


def _counted(spark: SparkSession, root: str) -> DataFrame:
    """Rows, ids, numbers and texts of each stored table, per day."""
    sums = {
        "log_events": "length(event_name) + coalesce(length(attr_error), 0)",
        "tool_events": "duration_ms + length(tool_name)",
        "token_usage": "count + length(token_type)",
        "cost_usage": "round(cost_usd * 100000)",
        "session_metrics": "value + length(metric_name)",
    }
    parts = [
        tables.read(spark, root, name)
        .groupBy(F.lit(name).alias("kind"), "event_date")
        .agg(
            F.count("*").alias("stored"),
            F.sum("id").alias("ids"),
            F.sum(F.expr(f"cast({measure} as double)")).alias("total"),
            F.max("timestamp").alias("newest"),
        )
        for name, measure in sums.items()
    ]
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five tables on disk, counted per day."""
    return shown(_counted(spark, _stored(spark, sf_dir)[1]))


def store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after several loads were packed, and one of them was run again."""
    t, root = _stored(spark, sf_dir, loads=3)
    compaction.compact(spark, root, LAST_DAY)
    some = t.base.where(F.col("id") % 3 == 1)
    tables.append_tables({name: build(some) for name, build in fixture.TABLES.items()}, root, "load-1")
    compaction.compact(spark, root, LAST_DAY)
    compaction.clean(spark, root, grace_hours=-1)
    return shown(_counted(spark, root))


LAST_DAY = date(2024, 1, 30)


def store_tool_metrics_last_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tool report of the last week over tables on disk."""
    _, root = _stored(spark, sf_dir)
    since = _since("last_week")
    calls = events.unified_tool_events(
        tables.read(spark, root, "tool_events", since), tables.read(spark, root, "log_events", since)
    )
    return shown(tools.tool_metrics(calls))


def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per table, day and family that the retention keeps."""
    _, root = _stored(spark, sf_dir)
    tables.prune(spark, root, fixture.AS_OF)
    # The retention begins at a midnight, so whole days are all there is to delete.
    parts = [
        tables.read(spark, root, name).select(
            F.lit(name).alias("kind"),
            "event_date",
            (F.col("event_family") if name == "log_events" else F.lit(None).cast("string")).alias("event_family"),
        )
        for name in fixture.TABLES
    ]
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first.groupBy("kind", "event_date", "event_family").agg(F.count("*").alias("events"))


def last_error_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest error of one tool, searched in the stored days from the newest on."""
    t = Telemetry(spark, sf_dir)
    root = new_folder(spark, "tables")
    names = ("log_events", "tool_events")
    tables.append_tables({name: getattr(t, name) for name in names}, root, "load-0")
    return shown(search_last_error(spark, root, "Bash"))


def _rolled_up(report: Callable[..., DataFrame], *names: str) -> Query:
    """A report of a range that cuts a day, over rollups of the days before the last one."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t, root = Telemetry(spark, sf_dir), new_folder(spark, "tables")
        sources = [source for name in names for source in rollups.ROLLUPS[name].sources]
        for load in range(2):  # the second comes after the rollup
            some = t.base.where((F.col("id") % 10 == 3) == (load == 1))
            tables.append_tables({name: fixture.TABLES[name](some) for name in sources}, root, f"load-{load}")
            if load == 0:
                rollups.build_rollups(spark, root, LAST_DAY, names)
        return shown(report(spark, root, CUT))

    return query


def _dashboard(range_name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, root = _stored(spark, sf_dir)
        return shown(refresh(dashboard(spark, root, fixture.AS_OF, range_name)))

    return query


def agents_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the tables with what stored agents, one more than the known ones, say of them."""
    t, root = Telemetry(spark, sf_dir), new_folder(spark, "agents")
    agent_tables.write_agents(spark, root, (*AGENTS, FIFTH_AGENT))
    known = agent_tables.read_agents(spark, root)
    tools_ = agent_tables.with_tool_agent(t.metrics().select("tool_name", "call_count"), known)
    models = agent_tables.with_model_names(api.calls_per_model(t.log_events), known)
    tokens = agent_tables.with_token_class(usage.tokens_by_type(t.token_usage), known)
    named = agent_tables.with_prefix_agent(t.log_events.groupBy("event_name").count(), known)
    parts = [
        tools_.selectExpr("'tool' as kind", "tool_name as name", "agent", "null as label", "call_count as amount"),
        models.selectExpr("'model' as kind", "model as name", "agent", "short_model as label", "calls as amount"),
        tokens.selectExpr("'token' as kind", "token_type as name", "agent", "token_class as label", "tokens as amount"),
        named.selectExpr("'event' as kind", "event_name as name", "agent", "null as label", "count as amount"),
    ]
    first, *rest = (part.withColumn("label", F.col("label").cast("string")) for part in parts)
    for part in rest:
        first = first.unionByName(part)
    return shown(agent_tables.with_agent_name(first, known).select("kind", "name", "agent_name", "label", "amount"))


def ingest_metrics_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric requests into the tables and back, with the time of arrival that their rows have."""
    t, root = Telemetry(spark, sf_dir), new_folder(spark, "arrival")
    tables.append_metric_payloads(fixture.metric_payloads(t.base), root, "load-0")
    names = ("token_usage", "cost_usage", "session_metrics")
    return shown(_routed_rows(*[tables.read(spark, root, name) for name in names], "timestamp"))


def stream_ingest_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log requests from text files through the streaming ingest and back from disk."""
    folder = new_folder(spark, "ingest-logs")
    fixture.log_payloads(fixture.base_events(spark, sf_dir)).select("payload").write.text(
        f"{folder}/in"
    )
    ingest.start_ingest(
        ingest.payload_stream(spark, f"{folder}/in"),
        f"{folder}/tables",
        f"{folder}/checkpoint",
        "logs",
        availableNow=True,
    ).awaitTermination()
    return shown(_flat_log_rows(tables.read(spark, f"{folder}/tables", "log_events")))


def stream_ingest_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log requests through two streams that run at once, each with its own checkpoint, into one table set."""
    folder = new_folder(spark, "ingest-two")
    payloads = fixture.log_payloads(fixture.base_events(spark, sf_dir))
    running = []
    for source in (0, 1):
        payloads.where(F.col("request") % 2 == source).select("payload").write.text(
            f"{folder}/in-{source}"
        )
    for source in (0, 1):
        stream = ingest.payload_stream(spark, f"{folder}/in-{source}")
        place = f"{folder}/tables", f"{folder}/checkpoint-{source}"
        running.append(ingest.start_ingest(stream, *place, "logs", availableNow=True))
    for query in running:
        query.awaitTermination()
    return shown(_flat_log_rows(tables.read(spark, f"{folder}/tables", "log_events")))


def stream_ingest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric requests from text files through the streaming ingest and back from disk."""
    folder = new_folder(spark, "ingest-metrics")
    fixture.metric_payloads(fixture.base_events(spark, sf_dir)).select("payload").write.text(
        f"{folder}/in"
    )
    ingest.start_ingest(
        ingest.payload_stream(spark, f"{folder}/in"),
        f"{folder}/tables",
        f"{folder}/checkpoint",
        "metrics",
        availableNow=True,
    ).awaitTermination()
    names = ("token_usage", "cost_usage", "session_metrics")
    return shown(_routed_rows(*[tables.read(spark, f"{folder}/tables", n) for n in names]))


def _live(report: Callable[..., DataFrame], *names: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = [fixture.TABLES[name](fixture.base_stream(spark, sf_dir)) for name in names or ("log_events",)]
        return shown(live.report_now(report(*rows), new_folder(spark, "live")))

    return query


def _closed(windows: Callable[..., DataFrame], *names: str) -> Query:
    """Windows with a delay that have closed at the end of the given events."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = [fixture.TABLES[name](fixture.base_stream(spark, sf_dir)) for name in names]
        return shown(live.closed_now(windows(*rows), new_folder(spark, "closed")))

    return query


def stream_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents seen in a stream of log events."""
    rows = fixture.log_events(fixture.base_stream(spark, sf_dir))
    return shown(live.agents_seen(live.report_now(live.stream_sightings(rows), new_folder(spark, "live"))))


# Which file of a stream an event comes in: those of the last come after windows they belong to have closed.
_ARRIVAL = "case when id % 10 = 7 then 2 when id % 10 = 6 and timestamp < '2024-01-15' then 1 else 0 end"


def stream_late_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that came too late for their window, from what is stored and what was written of closed windows."""
    folder, base = new_folder(spark, "late"), fixture.base_events(spark, sf_dir)
    logs = fixture.log_events(base)
    for arrival in range(3):
        logs.where(F.expr(_ARRIVAL) == arrival).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    closed = live.closed_now(live.stream_windows(stream, delay="1 hour"), folder)
    return shown(live.late_calls(closed, events.logged_tool_calls(logs)))


def _range_of_panes(report: Callable[..., DataFrame]) -> Query:
    """A report of a trailing range over log requests that a stream has taken in."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = new_folder(spark, "panes")
        payloads = fixture.log_payloads(fixture.base_events(spark, sf_dir)).select("payload")
        payloads.repartition(2).write.text(f"{folder}/in")
        stream = ingest.payload_stream(spark, f"{folder}/in", files_per_batch=1)
        ingest.start_ingest(
            stream, f"{folder}/tables", f"{folder}/checkpoint", "logs", panes=True, availableNow=True
        ).awaitTermination()
        return shown(report(spark, f"{folder}/tables", CUT))

    return query


ON_DISK: dict[str, Query] = {
    "store_roundtrip": store_roundtrip,
    "store_compacted": store_compacted,
    "store_tool_metrics_last_week": store_tool_metrics_last_week,
    "retention_prune": retention_prune,
    "last_error_one": last_error_one,
    "rollup_tool_metrics": _rolled_up(rollups.tool_metrics, "tool_days"),
    "rollup_api_totals": _rolled_up(rollups.api_totals, "api_days"),
    "rollup_api_by_model": _rolled_up(rollups.api_by_model, "api_days"),
    "rollup_token_totals": _rolled_up(rollups.token_totals, "token_days", "cost_days"),
    "rollup_session_metrics": _rolled_up(rollups.session_metrics, "session_days"),
    "dashboard_refresh": _dashboard("all_time"),
    "dashboard_refresh_last_week": _dashboard("last_week"),
    "agents_from_table": agents_from_table,
    "ingest_metrics_arrival": ingest_metrics_arrival,
    "stream_ingest_logs": stream_ingest_logs,
    "stream_ingest_two_sources": stream_ingest_two_sources,
    "stream_ingest_metrics": stream_ingest_metrics,
    "stream_tool_metrics": _live(live.stream_tool_metrics),
    "stream_unified_tool_metrics": _live(live.stream_unified_tool_metrics, "tool_events", "log_events"),
    "stream_hourly_windows": _live(live.stream_windows),
    "stream_sliding_windows": _live(lambda logs: live.stream_windows(logs, "1 hour", "30 minutes")),
    "stream_closed_windows": _closed(lambda logs: live.stream_windows(logs, delay="1 hour"), "log_events"),
    "stream_closed_sliding_windows": _closed(
        lambda logs: live.stream_windows(logs, "1 hour", "30 minutes", "2 hours"), "log_events"
    ),
    "stream_unified_windows": _closed(
        lambda legacy, logs: live.stream_unified_windows(
            legacy, logs, legacy_delay="5 hours", logs_delay="1 hour"
        ),
        "tool_events",
        "log_events",
    ),
    "stream_late_calls": stream_late_calls,
    "stream_range_tool_metrics": _range_of_panes(panes.range_tool_metrics),
    "stream_range_api_totals": _range_of_panes(panes.range_api_totals),
    "stream_range_api_by_model": _range_of_panes(panes.range_api_by_model),
    "stream_agents": stream_agents,
    "stream_last_errors": _live(live.stream_last_errors),
    "stream_unified_last_errors": _live(live.stream_unified_last_errors, "tool_events", "log_events"),
    "stream_api_by_model": _live(live.stream_api_by_model),
    "stream_api_totals": _live(live.stream_api_totals),
    "stream_tokens_by_type": _live(live.stream_tokens_by_type, "token_usage"),
    "stream_token_totals": _live(live.stream_token_totals, "token_usage"),
    "stream_cost_total": _live(live.stream_cost_total, "cost_usage"),
    "stream_session_by_name": _live(live.stream_session_by_name, "session_metrics"),
    "stream_session_metrics": _live(live.stream_session_metrics, "session_metrics"),
}


def _over_tables(build: Callable[[Telemetry], DataFrame]) -> Query:
    return lambda spark, sf_dir: shown(build(Telemetry(spark, sf_dir)))


def all_queries() -> dict[str, Query]:
    over_tables = {name: _over_tables(build) for name, build in {**BATCH, **INGEST}.items()}
    return {**over_tables, **ON_DISK}
