"""Stored daily partials, and reports of a range made of them and of the rows at its cut edges.

A rollup holds the partials of a day, and the names of the folders they were
counted from. A report takes a day from its rollup if that still stands for
rows that count, adds folders that came later, and reads rows themselves only
for days that are cut by the range or have no rollup yet.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime, time, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill import files
from telemill.functions.attributes import since_filter
from telemill.operators import partials, usage
from telemill.operators.events import unified_tool_events
from telemill.session import prepare_session
from telemill.sources import tables
from telemill.sources.commits import NO_DAY, REWRITE, Commits, Place, read_commits, replaced_by

Frames = dict[str, DataFrame]


@dataclass(frozen=True)
class Rollup:
    """Partials of some tables: what they are made of, and how."""

    sources: tuple[str, ...]
    partials: Callable[[Frames, Column], DataFrame]


ROLLUPS: dict[str, Rollup] = {
    "tool_days": Rollup(
        ("tool_events", "log_events"),
        lambda t, day: partials.tool_partials(unified_tool_events(t["tool_events"], t["log_events"]), day),
    ),
    "api_days": Rollup(("log_events",), lambda t, day: partials.api_partials(t["log_events"], day)),
    "token_days": Rollup(("token_usage",), lambda t, day: partials.token_partials(t["token_usage"], day)),
    "cost_days": Rollup(("cost_usage",), lambda t, day: partials.cost_partials(t["cost_usage"], day)),
    "session_days": Rollup(
        ("session_metrics",), lambda t, day: partials.session_partials(t["session_metrics"], day)
    ),
}


@dataclass
class DayRollup:
    """One day of a rollup: where its partials lie, and the attempts they were counted from."""

    attempt: str
    counted: set[tuple[str, str]]  # table and attempt


@dataclass
class Sources:
    """Where the rows of a range are to be read from."""

    rollup: list[str] = field(default_factory=list)
    rows: dict[str, list[str]] = field(default_factory=dict)


def _day_start() -> Column:
    return F.date_trunc("day", "timestamp")


class _Attempts:
    """The attempts whose rows a folder holds: its own, or those that a rewrite was made of."""

    def __init__(self, spark: SparkSession, root: str, committed: Commits):
        self.spark, self.root, self.stale = spark, root, committed.stale
        self.rewrites: dict[str, set[Place]] = {}

    def of(self, place: Place) -> set[tuple[str, str]]:
        table, day, attempt = place
        if not attempt.startswith(REWRITE):
            return {(table, attempt)}
        if attempt not in self.rewrites:
            self.rewrites[attempt] = replaced_by(self.spark, self.root, table, attempt)
        held = [p for p in self.rewrites[attempt] if p[:2] == (table, day)]
        return {a for p in held for a in self.of(p) if a[1] not in self.stale.get(table, ())}


def build_rollups(spark: SparkSession, root: str, before: date, names: tuple[str, ...] = tuple(ROLLUPS)) -> list[str]:
    """Roll up the days before a date that have no rollup that holds all of their rows; return their folders' days.

    One job a rollup, over the rows of these days alone. A day that got rows
    since its last rollup is counted anew.
    """
    prepare_session(spark)
    committed, done = read_commits(spark, root), []
    known = _Attempts(spark, root, committed)
    for name in names:
        rollup, days = ROLLUPS[name], {}
        for table in rollup.sources:
            for day in tables.day_folders(spark, root, table):
                if day != NO_DAY and date.fromisoformat(day) < before:
                    days.setdefault(day, {})
        standing = day_rollups(spark, root, name)
        for table in rollup.sources:
            for place, paths in tables.places(spark, root, table, sorted(days)).items():
                if committed.counts(place):
                    days[place[1]][place] = paths
        open_days = {
            day: folders
            for day, folders in days.items()
            if folders and not _complete(standing.get(day), set(folders), known)
        }
        if not open_days:
            continue
        folders = [item for some in open_days.values() for item in some.items()]
        rows = {
            table: _rows(spark, root, table, [p for place, paths in folders if place[0] == table for p in paths], committed)
            for table in rollup.sources
        }
        attempt = f"rollup-{name}@{len(files.names(spark, f'{root}/_rollups/{name}@*')) + 1:06d}-{uuid.uuid4().hex[:8]}"
        counted = rollup.partials(rows, _day_start())
        tables.write_attempt(tables.stored_layout(counted, name), root, attempt)
        listed = {day: sorted(set().union(*map(known.of, some))) for day, some in open_days.items()}
        files.write_whole(spark, f"{root}/_rollups/{name}@{attempt.rpartition('@')[2]}", json.dumps(listed))
        done += sorted(open_days)
    return done


def _rows(spark: SparkSession, root: str, table: str, paths: list[str], committed: Commits) -> DataFrame:
    rows = committed.current(tables.scan(spark, root, table, paths), table)
    return rows.drop(*tables.hidden_columns(table))


def day_rollups(spark: SparkSession, root: str, name: str) -> dict[str, DayRollup]:
    """The newest rollup of each day."""
    found = {}
    for marker in sorted(files.names(spark, f"{root}/_rollups/{name}@*")):
        listed = json.loads(files.read_text(spark, f"{root}/_rollups/{marker}"))
        for day, counted in listed.items():
            found[day] = DayRollup(f"rollup-{marker}", {tuple(c) for c in counted})
    return found


def _complete(rollup: DayRollup | None, now: set[Place], known: _Attempts) -> bool:
    return rollup is not None and rollup.counted == set().union(*map(known.of, now))


def sources(
    spark: SparkSession, root: str, name: str, since: datetime | None, committed: Commits | None = None
) -> Sources:
    """Where a report of a range reads: rollups of whole days, and folders of rows for what they lack."""
    committed = committed or read_commits(spark, root)
    known, standing, found = _Attempts(spark, root, committed), day_rollups(spark, root, name), Sources()
    now: dict[str, dict[Place, list[str]]] = {}
    for table in ROLLUPS[name].sources:
        found.rows[table] = []
        days = tables.day_folders(spark, root, table, since)
        for place, paths in tables.places(spark, root, table, days).items():
            if committed.counts(place):
                now.setdefault(place[1], {})[place] = paths
    for day, folders in now.items():
        whole = day != NO_DAY and (since is None or _start_of(day) >= _utc(since))
        rollup = standing.get(day) if whole else None
        held = {place: known.of(place) for place in folders}
        fits = rollup is not None and rollup.counted <= set().union(*held.values())
        if fits:
            # A folder is in the rollup as a whole or not at all; a mixed one was rewritten since.
            mixed = [h for h in held.values() if h & rollup.counted and not h <= rollup.counted]
            fits = not mixed
        if fits:
            found.rollup += [
                f"{root}/table={name}/event_date={day}/event_family={NO_DAY}"
                f"/load_id={files.escaped(spark, rollup.attempt)}"
            ]
        for place, paths in folders.items():
            if not (fits and held[place] <= rollup.counted):
                found.rows[place[0]] += paths
    found.rollup = [path for path in found.rollup if files.matching(spark, path)]
    return found


def _utc(moment: datetime) -> datetime:
    return moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment


def _start_of(day: str) -> datetime:
    return datetime.combine(date.fromisoformat(day), time(), timezone.utc)


def range_partials(
    spark: SparkSession, root: str, name: str, since: datetime | None = None, committed: Commits | None = None
) -> DataFrame:
    """Partials of a range: stored ones of its whole days, and ones made of rows for the rest."""
    prepare_session(spark)
    committed = committed or read_commits(spark, root)
    where = sources(spark, root, name, since, committed)
    rows = {
        table: since_filter(_rows(spark, root, table, paths, committed), since)
        for table, paths in where.rows.items()
    }
    made = ROLLUPS[name].partials(rows, _day_start())
    stored = tables.read_folders(spark, root, name, where.rollup)
    return made.unionByName(stored.select(*made.columns))


def tool_metrics(spark: SparkSession, root: str, since: datetime | None = None) -> DataFrame:
    """The tool report of a range."""
    return partials.merged_tool_metrics(range_partials(spark, root, "tool_days", since))


def api_totals(spark: SparkSession, root: str, since: datetime | None = None) -> DataFrame:
    """Calls, errors and mean latency of a range."""
    return partials.merged_api_totals(range_partials(spark, root, "api_days", since))


def api_by_model(spark: SparkSession, root: str, since: datetime | None = None) -> DataFrame:
    """Calls and mean latency per model of a range."""
    return partials.merged_api_by_model(range_partials(spark, root, "api_days", since))


def token_totals(spark: SparkSession, root: str, since: datetime | None = None) -> DataFrame:
    """Tokens by class and cost of a range."""
    committed = read_commits(spark, root)
    tokens = range_partials(spark, root, "token_days", since, committed)
    return usage.token_totals(tokens, range_partials(spark, root, "cost_days", since, committed))


def session_metrics(spark: SparkSession, root: str, since: datetime | None = None) -> DataFrame:
    """Lines, commits and active seconds of a range."""
    return usage.session_metrics(range_partials(spark, root, "session_days", since))
