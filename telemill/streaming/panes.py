"""Live reports of a trailing range, merged from panes of a minute instead of a scan of its rows.

Every micro-batch of logs adds the partials of its own rows, with the commit
that makes the rows visible, so there is no state to keep and nothing is ever
too late. A refresh reads one row per minute and tool for the range, and the
rows themselves for the one minute that the range cuts.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.functions.attributes import since_filter, utc_literal
from telemill.operators import partials
from telemill.sources import tables
from telemill.sources.commits import Commits, read_commits

PANE = timedelta(minutes=1)


def first_whole_pane(since: datetime) -> datetime:
    """The first start of a minute that is not before a moment."""
    start = since.replace(second=0, microsecond=0)
    return start if start == since else start + PANE


def range_panes(
    spark: SparkSession, root: str, table: str, since: datetime | None, committed: Commits | None = None
) -> DataFrame:
    """Partials of a range: whole panes, and those of the rows in the minute that is cut."""
    committed = committed or read_commits(spark, root)
    if since is None:
        return tables.read(spark, root, table, committed=committed)
    whole = first_whole_pane(since)
    panes = tables.read(spark, root, table, whole, committed=committed)
    if whole == since:
        return panes
    days = tables.day_folders(spark, root, "log_events", since)[:1]
    cut = tables.read(spark, root, "log_events", since, days, committed).where(F.col("timestamp") < utc_literal(whole))
    return tables.minute_partials(cut)[table].unionByName(panes.select(*tables.TABLES[table].fieldNames()))


def range_tool_metrics(spark: SparkSession, root: str, since: datetime | None) -> DataFrame:
    """The tool report of the logged calls at or after a moment."""
    return partials.merged_tool_metrics(range_panes(spark, root, "tool_panes", since))


def range_api_totals(spark: SparkSession, root: str, since: datetime | None) -> DataFrame:
    """Calls, errors and mean latency at or after a moment."""
    return partials.merged_api_totals(range_panes(spark, root, "api_panes", since))


def range_api_by_model(spark: SparkSession, root: str, since: datetime | None) -> DataFrame:
    """Calls and mean latency per model at or after a moment."""
    return partials.merged_api_by_model(range_panes(spark, root, "api_panes", since))
