"""What readers see of loads that are under way, run again, packed and cleaned."""

from __future__ import annotations

import threading
from datetime import date

import pytest
from pyspark.sql import functions as F

from telemill import files
from telemill.operators import events, tools
from telemill.sources import commits, compaction, tables
from telemill.sources.commits import commit, new_attempt, read_commits
from telemill.streaming import ingest
from tests.helpers import legacy, logs, table, tool_result

DAY = 86400
LATER = date(2024, 2, 1)


def ids(spark, root, name="log_events"):
    return sorted(r.id for r in tables.read(spark, root, name).select("id").collect())


def calls(spark, *days, start=0):
    """One call for each day given, with ids from a start."""
    rows = logs(spark, *[(*tool_result("t"), day * DAY) for day in days])
    return rows.withColumn("id", F.col("id") + start)


def file_count(root, spark, name="log_events"):
    return len(files.names(spark, f"{root}/table={name}/*/*/*/*.parquet"))


def test_nothing_of_a_load_is_seen_before_its_commit(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    first = {"token_usage": table(spark, "token_usage", ("input", 1)), "cost_usage": table(spark, "cost_usage", (0.5,))}
    tables.append_tables(first, root, "one")
    again = {"token_usage": table(spark, "token_usage", ("input", 7)), "cost_usage": table(spark, "cost_usage", (9.0,))}

    def fails(*_):
        raise RuntimeError("stopped between write and commit")

    with monkeypatch.context() as patch:
        patch.setattr(tables, "commit", fails)
        with pytest.raises(RuntimeError, match="stopped"):
            tables.append_tables(again, root, "one")
        with pytest.raises(RuntimeError, match="stopped"):
            tables.append_tables(again, root, "two")

    def seen():
        tokens, costs = (tables.read(spark, root, name).collect() for name in ("token_usage", "cost_usage"))
        return [r["count"] for r in tokens], [r.cost_usd for r in costs]

    assert seen() == ([1], [0.5])
    tables.append_tables(again, root, "one")
    assert seen() == ([7], [9.0])


def test_a_reader_between_the_tables_of_a_load_sees_none_of_it(spark, tmp_path):
    root = str(tmp_path)
    attempt = new_attempt(spark, root, "one")
    for name, rows in (("token_usage", table(spark, "token_usage", ("input", 1))), ("cost_usage", table(spark, "cost_usage", (1.0,)))):
        tables.write_attempt(tables.stored_layout(rows, name), root, attempt)
        assert all(tables.read(spark, root, n).count() == 0 for n in ("token_usage", "cost_usage"))
    commit(spark, root, attempt, ["token_usage", "cost_usage"])
    assert all(tables.read(spark, root, n).count() == 1 for n in ("token_usage", "cost_usage"))


def test_frames_of_one_moment(spark, tmp_path):
    root = str(tmp_path)
    tables.append(calls(spark, 0), root, "log_events", "a")
    moment = read_commits(spark, root)
    tables.append(calls(spark, 0), root, "log_events", "b")
    assert tables.read(spark, root, "log_events", committed=moment).count() == 1
    assert tables.read(spark, root, "log_events").count() == 2


def test_loads_of_the_same_name_in_other_tables_stay(spark, tmp_path):
    root = str(tmp_path)
    tables.append(calls(spark, 0), root, "log_events", "one")
    tables.append(legacy(spark, ("a", True, 1, None)), root, "tool_events", "one")
    tables.append(calls(spark, 0, start=5), root, "log_events", "one")
    assert ids(spark, root) == [5] and ids(spark, root, "tool_events") == [0]


def test_awkward_load_names(spark, tmp_path):
    root = str(tmp_path)
    names = ["2024-01-10T12:00", "a/b=c", "x~y", "a@1", "50% [x]*?{}", "rewrites"]
    for place, name in enumerate([*names, *names]):
        tables.append(calls(spark, 0, start=place), root, "log_events", name)
    assert ids(spark, root) == list(range(len(names), 2 * len(names)))


def test_many_attempts_are_joined_not_listed(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    for name in "abc":
        tables.append(calls(spark, 0, start=ord(name)), root, "log_events", name)
    monkeypatch.setattr(commits, "LITERALS", 2)
    assert len(ids(spark, root)) == 3


def test_streams_that_write_at_once(spark, tmp_path):
    payload = '{"resourceLogs":[{"scopeLogs":[{"logRecords":[{},{}]}]}]}'
    root, queries = str(tmp_path / "tables"), []
    for source in range(3):
        folder = str(tmp_path / f"in-{source}")
        spark.createDataFrame([(payload,)] * 40, "payload string").repartition(4).write.text(folder)
        stream = ingest.payload_stream(spark, folder, files_per_batch=1)
        queries.append(ingest.start_ingest(stream, root, str(tmp_path / f"c-{source}"), "logs", availableNow=True))
    assert sum(query.isActive for query in queries) > 1
    for query in queries:
        query.awaitTermination()
    assert tables.read(spark, root, "log_events").count() == 3 * 40 * 2


def test_compaction_keeps_rows_and_packs_files(spark, tmp_path):
    root = str(tmp_path)
    for load in range(4):
        tables.append(calls(spark, 0, 1, 40, start=10 * load), root, "log_events", f"load-{load}")
    before, moment = ids(spark, root), read_commits(spark, root)
    old_reader = tables.read(spark, root, "log_events", committed=moment)
    done = compaction.compact(spark, root, LATER)
    assert {day for _, day, _ in done} == {"2024-01-10", "2024-01-11"} and len(done) == 8
    assert ids(spark, root) == before
    report = tools.tool_metrics(events.logged_tool_calls(tables.read(spark, root, "log_events"))).first()
    assert report.call_count == 12
    assert old_reader.count() == 12  # its files are still there
    assert compaction.compact(spark, root, LATER) == []  # nothing is left to pack
    assert compaction.clean(spark, root) == []  # within the grace
    deleted = compaction.clean(spark, root, grace_hours=-1)
    assert len(deleted) == 8 and ids(spark, root) == before
    assert file_count(root, spark) == 2 + 4  # one a closed day, the open day as it was
    assert read_commits(spark, root).replaced == set()


def test_compaction_leaves_large_folders_and_open_days(spark, tmp_path):
    root = str(tmp_path)
    for load in range(3):
        tables.append(calls(spark, 0, start=load), root, "log_events", f"load-{load}")
    assert compaction.compact(spark, root, date(2024, 1, 10)) == []
    assert compaction.compact(spark, root, LATER, small=1) == []
    assert len(compaction.compact(spark, root, LATER)) == 3


def test_a_load_run_again_after_and_during_compaction(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    for load in "abc":
        tables.append(calls(spark, 0, start=ord(load)), root, "log_events", load)
    compaction.compact(spark, root, LATER)
    tables.append(calls(spark, 1, start=1), root, "log_events", "b")
    assert ids(spark, root) == [1, ord("a"), ord("c")]
    tables.append(calls(spark, 0, start=2), root, "log_events", "d")

    def slow_commit(*given):
        # While the rewrite is being written, one of its loads is run once more.
        tables.append(calls(spark, 0, start=3), root, "log_events", "a")
        commit(*given)

    with monkeypatch.context() as patch:
        patch.setattr(compaction, "commit", slow_commit)
        compaction.compact(spark, root, LATER)
    assert ids(spark, root) == [1, 2, 3, ord("c")]
    compaction.clean(spark, root, grace_hours=-1)
    assert ids(spark, root) == [1, 2, 3, ord("c")]
    compaction.compact(spark, root, LATER)
    compaction.clean(spark, root, grace_hours=-1)
    assert ids(spark, root) == [1, 2, 3, ord("c")]


def test_two_compactions_at_once_count_rows_once(spark, tmp_path):
    root = str(tmp_path)
    for load in "abc":
        tables.append(calls(spark, 0, start=ord(load)), root, "log_events", load)
    moment = read_commits(spark, root)
    days = tables.day_folders(spark, root, "log_events")
    chosen = compaction._small_folders(spark, root, "log_events", days, moment, compaction.SMALL)
    assert compaction._rewrite(spark, root, "log_events", chosen, moment)
    assert not compaction._rewrite(spark, root, "log_events", chosen, moment)
    # The same, had both looked before either of them committed.
    rows = tables.scan(spark, root, "log_events", [p for some in chosen.values() for p in some])
    attempt = "rewrite-99999999999999999999-x"
    layout = rows.drop("event_date", "load_id").withColumn("table", F.lit("log_events"))
    tables.write_attempt(layout, root, attempt)
    commit(spark, root, attempt, ["log_events"], sorted(chosen))
    assert read_commits(spark, root).void == {("log_events", attempt)}
    for grace in (24, -1):
        assert ids(spark, root) == [97, 98, 99] and read_commits(spark, root).replaced == set(chosen)
        compaction.clean(spark, root, grace_hours=grace)
    assert ids(spark, root) == [97, 98, 99] and file_count(root, spark) == 1


def test_rows_without_a_time_are_kept_apart(spark, tmp_path):
    root = str(tmp_path)
    for load in "ab":
        rows = calls(spark, 0, start=ord(load)).withColumn("timestamp", F.lit(None).cast("timestamp"))
        tables.append(rows, root, "log_events", load)
    assert compaction.compact(spark, root, LATER) == []
    assert ids(spark, root) == [97, 98]


def test_cleaning_takes_unfinished_and_replaced_attempts(spark, tmp_path):
    root = str(tmp_path)
    tables.write_attempt(tables.stored_layout(calls(spark, 0), "log_events"), root, new_attempt(spark, root, "dead"))
    for start in (5, 6):
        tables.append(calls(spark, 0, start=start), root, "log_events", "live")
    assert len(compaction.clean(spark, root, grace_hours=-1)) == 2
    assert ids(spark, root) == [6] and file_count(root, spark) == 1


def test_readers_during_compaction(spark, tmp_path):
    """Every read that runs beside loads and compactions sees whole loads."""
    root, seen, stop = str(tmp_path), [], threading.Event()

    def reader():
        while not stop.is_set():
            seen.append(tables.read(spark, root, "log_events").count())

    thread = threading.Thread(target=reader)
    thread.start()
    try:
        for load in range(4):
            tables.append(calls(spark, 0, 1, 2, start=3 * load), root, "log_events", f"l{load}")
            compaction.compact(spark, root, LATER)
    finally:
        stop.set()
        thread.join()
    assert seen == sorted(seen) and {n % 3 for n in seen} == {0}
