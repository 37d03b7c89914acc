"""The last error of one tool, searched from the newest day of the stored tables backwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from telemill.operators.events import last_error, tool_errors
from telemill.sources import tables
from telemill.sources.commits import NO_DAY, read_commits

FIRST_STEP = 1  # days read at first; each further step reads twice as many


def search_last_error(spark: SparkSession, root: str, tool: str) -> DataFrame:
    """Newest error of a tool: one row, or none.

    Reads the newest day of both event tables; if the tool has no error on it,
    the two days before, then the four before these, and so on. Rows without a
    time come last. A tool that failed lately costs one day, one that never did
    the table, in as many jobs as doublings.
    """
    committed = read_commits(spark, root)
    names = ("tool_events", "log_events")
    days = sorted({day for name in names for day in tables.day_folders(spark, root, name)} - {NO_DAY}, reverse=True)
    days.append(NO_DAY)
    start, step, found = 0, FIRST_STEP, None
    while start < len(days):
        chosen = set(days[start : start + step])
        legacy, logs = (
            tables.read(
                spark, root, name, days=[d for d in tables.day_folders(spark, root, name) if d in chosen], committed=committed
            )
            for name in names
        )
        found = last_error(tool_errors(legacy, logs), tool)
        if start + step >= len(days) or not found.isEmpty():
            return found
        start, step = start + step, 2 * step
    return found
