"""Which files of a table set count: a load writes one small file last, and readers go by these.

A run of a load writes all its rows under a name that no other run has, its
attempt, and then ``<root>/_commits/<attempt>~<its tables>``. Until that file is
there, readers see nothing of it in any table; from then on, all of it, and in
these tables nothing of the load's earlier attempts.

A rewrite (see ``compaction``) commits the same way, with the folders whose
rows it holds as the content of its file; these are left out from then on, and
deleted later.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill import files

REWRITE = "rewrite-"
CLEANED = ".cleaned"
# Names up to which attempts are literals of the plan, which prune folders while planning.
LITERALS = 5000

# A folder of rows, as far as commits go: table, day and attempt.
Place = tuple[str, str, str]


def new_attempt(spark: SparkSession, root: str, load: str) -> str:
    """A name for one run of a load: later than those committed, and like no other."""
    earlier = files.names(spark, f"{root}/_commits/{files.escaped(spark, load)}@*")
    return f"{load}@{len(earlier) + 1:06d}-{uuid.uuid4().hex[:8]}"


def load_of(attempt: str) -> str:
    return attempt.rpartition("@")[0]


def commit(
    spark: SparkSession, root: str, attempt: str, tables: Sequence[str], replaced: list[Place] | None = None
) -> None:
    """Make an attempt count, in all its tables at once."""
    text = json.dumps({"replaced": replaced}) if replaced else ""
    files.write_whole(spark, f"{root}/_commits/{files.escaped(spark, attempt)}~{'+'.join(tables)}", text)


@dataclass
class Commits:
    """What counts at one moment, by table."""

    attempts: dict[str, set[str]] = field(default_factory=dict)
    stale: dict[str, set[str]] = field(default_factory=dict)  # attempts of loads that were run again
    rewrites: dict[str, set[str]] = field(default_factory=dict)
    replaced: set[Place] = field(default_factory=set)  # folders whose rows a rewrite holds
    void: set[tuple[str, str]] = field(default_factory=set)  # rewrites of what another rewrite holds

    def counts(self, place: Place) -> bool:
        return place[2] in self.attempts.get(place[0], ()) and place not in self.replaced

    def current(self, rows: DataFrame, table: str) -> DataFrame:
        """Without the rows in rewrites whose load was run again since: told by the attempt they came from."""
        stale = self.stale.get(table) if self.rewrites.get(table) else None
        return rows.where(~F.col("origin").isin(*sorted(stale))) if stale else rows

    def visible(self, rows: DataFrame, table: str) -> DataFrame:
        """The rows of a table that count; attempts and replaced folders are told by partition columns."""
        attempts = sorted(self.attempts.get(table, ()))
        if len(attempts) > LITERALS:
            listed = rows.sparkSession.createDataFrame([(a,) for a in attempts], "load_id string")
            rows = rows.join(listed, "load_id", "left_semi")
        else:
            rows = rows.where(F.col("load_id").isin(*attempts))
        days: dict[str, list[str]] = {}
        for of_table, day, attempt in sorted(self.replaced):
            if of_table == table:
                days.setdefault(day, []).append(attempt)
        for day, gone in days.items():
            rows = rows.where(~(_is_day(day) & F.col("load_id").isin(*gone)))
        return self.current(rows, table)


def _is_day(day: str) -> Column:
    """Whether a row lies in the folder of a day; rows without a time have a folder of their own."""
    return F.col("event_date").eqNullSafe(F.lit(None if day == NO_DAY else day).cast("date"))


NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def read_commits(spark: SparkSession, root: str) -> Commits:
    """What counts now. One listing; only rewrites whose old folders are still there are opened.

    Of two rewrites that hold the same folder, which can only have run at once,
    the first by name counts.
    """
    found = Commits()
    newest: dict[tuple[str, str], str] = {}
    listed = [name for name in files.names(spark, f"{root}/_commits/*") if not name.startswith(".")]
    cleaned = {name.removesuffix(CLEANED) for name in listed if name.endswith(CLEANED)}
    for name in listed:
        if name.endswith(CLEANED):
            continue
        attempt, _, of_tables = files.unescaped(spark, name).rpartition("~")
        for table in of_tables.split("+"):
            if attempt.startswith(REWRITE):
                places = set() if name in cleaned else replaced_by(spark, root, table, attempt)
                if places.isdisjoint(found.replaced):
                    found.attempts.setdefault(table, set()).add(attempt)
                    found.rewrites.setdefault(table, set()).add(attempt)
                    found.replaced |= places
                else:
                    found.void.add((table, attempt))
            else:
                found.stale.setdefault(table, set()).add(attempt)
                key = table, load_of(attempt)
                newest[key] = max(newest.get(key, attempt), attempt)
    for (table, _), attempt in newest.items():
        found.attempts.setdefault(table, set()).add(attempt)
        found.stale[table].discard(attempt)
    return found


def withdraw(spark: SparkSession, root: str, table: str, attempt: str) -> None:
    """Take back the commit of a rewrite that does not count."""
    files.delete(spark, f"{root}/_commits/{files.escaped(spark, attempt)}~{table}")


def replaced_by(spark: SparkSession, root: str, table: str, attempt: str) -> set[Place]:
    """The folders whose rows a rewrite of a table holds."""
    text = files.read_text(spark, f"{root}/_commits/{files.escaped(spark, attempt)}~{table}")
    return {tuple(place) for place in json.loads(text or "{}").get("replaced", [])}
