"""The table set on disk: append, read and prune.

Layout: ``<root>/table=<name>/event_date=<day>/event_family=<family>/load_id=<attempt>``.
Day and family prune the scan of every report; the attempt is one run of a load.
Readers see it once it is committed (see ``commits``), in all its tables at
once, and only the last one of each load.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill import files
from telemill.fixed_values import QUERY_ATTRIBUTES, RETENTION_DAYS
from telemill.functions.attributes import attribute, event_family, since_filter
from telemill.operators.events import logged_tool_calls
from telemill.operators.partials import PANE, api_partials, tool_partials
from telemill.schema import TABLES
from telemill.session import prepare_session
from telemill.sources.commits import NO_DAY, Commits, Place, commit, new_attempt, read_commits
from telemill.sources.otlp import log_rows, metric_rows, routed_points

LOG_TABLES = ("log_events", "bad_log_payloads")
PANE_TABLES = ("tool_panes", "api_panes")
METRIC_TABLES = ("token_usage", "cost_usage", "session_metrics", "bad_metric_payloads")

_PARTITIONS = ("table", "event_date", "event_family", "load_id")


def with_promoted_attributes(logs: DataFrame) -> DataFrame:
    """Add the attributes that reports read as columns of their own."""
    return logs.withColumns({f"attr_{key}": attribute(logs, key) for key in QUERY_ATTRIBUTES})


def stored_schema(table: str) -> T.StructType:
    """Columns of a table on disk."""
    fields = list(TABLES[table].fields)
    if table == "log_events":
        fields += [T.StructField(f"attr_{key}", T.StringType()) for key in QUERY_ATTRIBUTES]
    return T.StructType(
        [
            *fields,
            T.StructField("event_date", T.DateType()),
            T.StructField("event_family", T.StringType()),
            T.StructField("load_id", T.StringType()),
            T.StructField("origin", T.StringType()),
        ]
    )


def write_attempt(rows: DataFrame, root: str, attempt: str) -> None:
    """Write rows that name their ``table`` and ``event_family``, in one pass, for readers to see once committed.

    Rebalancing gives files of the advisory size whatever the number of tasks
    before it, and splits a day and family that holds most of the rows. Files
    are in time order, so that row groups prune within a day. The folders are
    new ones of this attempt; the mode is the one in which writers of the same
    root, each with a staging folder of its own, do not touch each other.
    ``origin`` keeps the attempt through later rewrites.
    """
    if "origin" not in rows.columns:
        rows = rows.withColumn("origin", F.lit(attempt))
    layout = rows.withColumns(
        {"event_date": F.to_date("timestamp"), "load_id": F.lit(attempt)}
    ).hint("rebalance", *_PARTITIONS)
    (
        layout.sortWithinPartitions(*_PARTITIONS, "timestamp")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*_PARTITIONS)
        .parquet(root)
    )


def stored_layout(rows: DataFrame, table: str) -> DataFrame:
    """Rows of one table as they are written; log attributes may be JSON text."""
    typed = rows.select(*TABLES[table].fieldNames())
    if table == "log_events":
        if isinstance(typed.schema["attributes"].dataType, T.StringType):
            as_map = F.from_json("attributes", TABLES[table]["attributes"].dataType)
            typed = typed.withColumn("attributes", as_map)
        typed = with_promoted_attributes(typed).withColumn("event_family", event_family())
    else:
        typed = typed.withColumn("event_family", F.lit(None).cast("string"))
    return typed.withColumn("table", F.lit(table))


def append(rows: DataFrame, root: str, table: str, load_id: str) -> None:
    """Append rows of one table under a load id; log attributes may be JSON text."""
    append_tables({table: rows}, root, load_id)


def append_tables(rows: Mapping[str, DataFrame], root: str, load_id: str) -> None:
    """Append rows of several tables as one load: all of them become visible at once."""
    spark = prepare_session(next(iter(rows.values())).sparkSession)
    attempt = new_attempt(spark, root, load_id)
    for table, some in rows.items():
        write_attempt(stored_layout(some, table), root, attempt)
    commit(spark, root, attempt, list(rows))


def append_log_payloads(payloads: DataFrame, root: str, load_id: str, panes: bool = False) -> None:
    """Parse log requests and append events and bad payloads, reading the input once.

    With ``panes``, the partial counts per minute of these events go into the
    tables ``tool_panes`` and ``api_panes`` with the same commit, read from the
    few columns of the rows just written.
    """
    spark = prepare_session(payloads.sparkSession)
    attempt = new_attempt(spark, root, load_id)
    rows = log_rows(payloads).withColumn(
        "table", F.when(F.col("valid"), "log_events").otherwise("bad_log_payloads")
    )
    promoted = with_promoted_attributes(rows).withColumn("event_family", event_family())
    write_attempt(promoted.drop("valid"), root, attempt)
    if panes:
        written = read_folders(spark, root, "log_events", _folders_of(spark, root, "log_events", attempt))
        for table, partials in minute_partials(written).items():
            write_attempt(stored_layout(partials, table), root, attempt)
    commit(spark, root, attempt, [*LOG_TABLES, *PANE_TABLES] if panes else LOG_TABLES)


def minute_partials(logs: DataFrame) -> dict[str, DataFrame]:
    """Partial counts per minute, by the table they are kept in."""
    minute = F.date_trunc(PANE, "timestamp")
    made = tool_partials(logged_tool_calls(logs), minute), api_partials(logs, minute)
    return dict(zip(PANE_TABLES, made))


def append_metric_payloads(
    payloads: DataFrame, root: str, load_id: str, profile: str = "json"
) -> None:
    """Parse metric requests and append to three tables and the bad payloads, reading once."""
    spark = prepare_session(payloads.sparkSession)
    attempt = new_attempt(spark, root, load_id)
    routed = routed_points(metric_rows(payloads), profile)
    write_attempt(routed.withColumn("event_family", F.lit(None).cast("string")), root, attempt)
    commit(spark, root, attempt, METRIC_TABLES)


def day_folders(spark: SparkSession, root: str, table: str, since: datetime | None = None) -> list[str]:
    """Days of a table that may hold rows at or after a moment, in order; rows without a time have none."""
    days = [name.removeprefix("event_date=") for name in files.names(spark, f"{root}/table={table}/event_date=*")]
    if since is None:
        return days
    first = (since.astimezone(timezone.utc) if since.tzinfo else since).date()
    return [day for day in days if day != NO_DAY and date.fromisoformat(day) >= first]


def scan(spark: SparkSession, root: str, table: str, paths: Sequence[str] | None = None) -> DataFrame:
    """All rows below some folders of a table (None: below all), committed or not; no other folder is listed."""
    schema, base = stored_schema(table), f"{root}/table={table}"
    if paths is None:
        paths = [f"{base}/event_date={day}" for day in day_folders(spark, root, table)]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", base).parquet(*paths)


def hidden_columns(table: str) -> list[str]:
    return ["load_id", "origin"] if table == "log_events" else ["load_id", "origin", "event_family"]


def read(
    spark: SparkSession,
    root: str,
    table: str,
    since: datetime | None = None,
    days: Sequence[str] | None = None,
    committed: Commits | None = None,
) -> DataFrame:
    """The committed rows of a table, optionally from a moment on or of some days; without files, an empty one.

    Only the folders of these days are listed. Frames that are to show the same
    moment are read with the same ``committed``.
    """
    prepare_session(spark)
    committed = committed or read_commits(spark, root)
    if days is None:
        days = day_folders(spark, root, table, since)
    rows = scan(spark, root, table, [f"{root}/table={table}/event_date={day}" for day in days])
    return since_filter(committed.visible(rows, table).drop(*hidden_columns(table)), since)


def places(spark: SparkSession, root: str, table: str, days: Sequence[str]) -> dict[Place, list[str]]:
    """The folders of each attempt in some days of a table, committed or not."""
    found: dict[Place, list[str]] = {}
    for day in days:
        pattern = f"{root}/table={table}/event_date={day}/event_family=*/load_id=*"
        for status in files.matching(spark, pattern):
            path = status.getPath()
            attempt = files.unescaped(spark, path.getName().removeprefix("load_id="))
            found.setdefault((table, day, attempt), []).append(path.toString())
    return found


def _folders_of(spark: SparkSession, root: str, table: str, attempt: str) -> list[str]:
    """The folders of one attempt, on whatever days."""
    pattern = f"{root}/table={table}/event_date=*/event_family=*/load_id={files.escaped(spark, attempt)}"
    return [status.getPath().toString() for status in files.matching(spark, pattern)]


def read_folders(spark: SparkSession, root: str, table: str, paths: Sequence[str]) -> DataFrame:
    """The rows of some folders that are known to count."""
    prepare_session(spark)
    return scan(spark, root, table, paths).drop(*hidden_columns(table))


def retained(rows: DataFrame, as_of: datetime, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows not older than the retention."""
    return since_filter(rows, as_of - timedelta(days=days))


def prune(spark: SparkSession, root: str, as_of: datetime, days: int = RETENTION_DAYS) -> list[str]:
    """Delete the days that lie wholly before the retention, in all tables; return their folders.

    Only folders are touched, no file is read or rewritten, and a pruning cut
    short is finished by the next one. ``retained`` cuts the oldest day exactly.
    """
    first_day = (as_of - timedelta(days=days)).date()
    deleted = []
    for status in files.matching(spark, f"{root}/table=*/event_date=*"):
        day = status.getPath().getName().removeprefix("event_date=")
        # Rows without a time lie in a folder that has no day, and stay.
        if day != NO_DAY and date.fromisoformat(day) < first_day:
            deleted.append(status.getPath().toString())
            files.delete(spark, deleted[-1])
    return deleted
