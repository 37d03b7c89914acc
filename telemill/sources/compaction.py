"""Many small loads of past days packed into few files, beside readers and loads that go on.

``compact`` writes the rows of small folders again under one attempt and
commits it with the list of folders it holds; a reader sees either those
folders or the rewrite. ``clean`` deletes what no reader that started lately can
still need. Large folders stay as they are, so a row is not copied again and
again.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from telemill import files
from telemill.schema import TABLES
from telemill.session import prepare_session
from telemill.sources import tables
from telemill.sources.commits import (
    CLEANED,
    NO_DAY,
    REWRITE,
    Commits,
    Place,
    commit,
    read_commits,
    replaced_by,
    withdraw,
)

SMALL = 64 << 20  # bytes of a folder from which it stays as it is
DAYS_AT_ONCE = 31  # days of a table in one job
PACKED = tuple(name for name in TABLES if not name.endswith("_days"))  # a rollup writes a day at once


def compact(
    spark: SparkSession,
    root: str,
    before: date,
    names: Sequence[str] = PACKED,
    small: int = SMALL,
) -> list[Place]:
    """Pack the small folders of the days before a date; return those that a rewrite now holds.

    A day and table with one small folder or none is left alone, so a second
    call finds nothing to do. A load that is run again in the meantime loses
    nothing: of a rewrite, only the rows of newest attempts count. Of two
    compactions at once, the rewrites of the later one are not committed or, if
    both commit in the same moment, do not count.
    """
    prepare_session(spark)
    committed, done = read_commits(spark, root), []
    for table in names:
        days = [day for day in tables.day_folders(spark, root, table) if _past(day, before)]
        for start in range(0, len(days), DAYS_AT_ONCE):
            chosen = _small_folders(spark, root, table, days[start : start + DAYS_AT_ONCE], committed, small)
            if chosen and _rewrite(spark, root, table, chosen, committed):
                done += chosen
    return done


def _past(day: str, before: date) -> bool:
    return day != NO_DAY and date.fromisoformat(day) < before


def _small_folders(
    spark: SparkSession, root: str, table: str, days: Sequence[str], committed: Commits, small: int
) -> dict[Place, list[str]]:
    """Committed attempts that are small on a day, where a day has several."""
    found = {
        place: paths
        for place, paths in tables.places(spark, root, table, days).items()
        if committed.counts(place) and sum(files.size(spark, path) for path in paths) < small
    }
    by_day = [day for _, day, _ in found]
    return {place: paths for place, paths in found.items() if by_day.count(place[1]) > 1}


def _rewrite(spark: SparkSession, root: str, table: str, chosen: dict[Place, list[str]], committed: Commits) -> bool:
    attempt = f"{REWRITE}{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    paths = [path for some in chosen.values() for path in some]
    # Rows of earlier attempts in an earlier rewrite go now.
    rows = committed.current(tables.scan(spark, root, table, paths), table)
    rows = rows.drop("event_date", "load_id").withColumn("table", F.lit(table))
    tables.write_attempt(rows, root, attempt)
    if not chosen.keys().isdisjoint(read_commits(spark, root).replaced):
        return False  # another compaction was faster; what was written here is for ``clean``
    commit(spark, root, attempt, [table], sorted(chosen))
    return True


def clean(spark: SparkSession, root: str, grace_hours: float = 24.0) -> list[str]:
    """Delete folders that do not count and have not been touched for some hours; return them.

    The grace has to outlast any running load and any running reader. Folders
    that a rewrite holds are thereby gone, so readers need not be told of them
    any more.
    """
    latest = (time.time() - 3600 * grace_hours) * 1000
    committed, deleted, left = read_commits(spark, root), [], set()
    for table, attempt in committed.void:
        withdraw(spark, root, table, attempt)
    for name in files.names(spark, f"{root}/table=*"):
        table = name.removeprefix("table=")
        if table not in PACKED:
            continue
        for place, paths in tables.places(spark, root, table, tables.day_folders(spark, root, table)).items():
            if committed.counts(place):
                continue
            for path in paths:
                if files.status_of(spark, path).getModificationTime() <= latest:
                    files.delete(spark, path)
                    deleted.append(path)
                else:
                    left.add(place)
    for table, attempts in committed.rewrites.items():
        for attempt in attempts:
            marker = f"{root}/_commits/{attempt}~{table}{CLEANED}"
            if not files.names(spark, marker) and left.isdisjoint(replaced_by(spark, root, table, attempt)):
                files.write_whole(spark, marker, "")
    return deleted
