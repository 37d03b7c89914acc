from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from telemill import schema
from telemill.operators import agents, api, events, tools
from telemill.plans import fixture
from telemill.sources import otlp, tables
from telemill.streaming import ingest, live, panes
from tests.helpers import at, legacy, logs, tool_result

SF = "/root/testdata/sf0.001"


def same(left, right):
    left = left.select(*right.columns)
    return left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def test_ingest_equals_batch_over_many_batches_and_restarts(spark, tmp_path):
    payloads = fixture.log_payloads(fixture.base_events(spark, SF)).select("payload")
    bad = spark.createDataFrame([("garbage",)], "payload string")
    source, root, checkpoint = (str(tmp_path / name) for name in ("in", "tables", "checkpoint"))
    payloads.unionByName(bad).repartition(4).write.text(source)

    def run():
        stream = ingest.payload_stream(spark, source, files_per_batch=1)
        query = ingest.start_ingest(stream, root, checkpoint, "logs", availableNow=True)
        query.awaitTermination()
        return query

    run()
    stored = tables.read(spark, root, "log_events")
    batch = otlp.parse_logs(
        spark.read.text(source).select(
            F.col("value").alias("payload"), F.current_timestamp().alias("ingest_ts")
        )
    )[0]
    columns = ["id", "timestamp", "event_name", "body"]
    loads = spark.read.parquet(f"{root}/table=log_events").select("load_id").distinct()
    assert loads.count() == 4
    assert same(stored.select(*columns), batch.select(*columns))
    assert tables.read(spark, root, "bad_log_payloads").count() == 1

    # New files are read once more on restart, old ones are not.
    bad.write.mode("append").text(source)
    run()
    assert tables.read(spark, root, "bad_log_payloads").count() == 2
    assert tables.read(spark, root, "log_events").count() == batch.count()


def test_a_repeated_batch_is_stored_once(spark, tmp_path):
    payload = json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [{}]}]}]})
    rows = spark.createDataFrame([(payload,)], "payload string").select(
        "payload", F.lit(at(0)).cast("timestamp").alias("ingest_ts")
    )
    root, checkpoint = str(tmp_path / "tables"), tmp_path / "checkpoint"
    checkpoint.mkdir()
    (checkpoint / "metadata").write_text('{"id": "s"}')
    for batch in (0, 1, 1):
        ingest._append_batch(rows, batch, "logs", root, "logs", str(checkpoint))
    assert tables.read(spark, root, "log_events").count() == 2


def stored_stream(spark, folder, *frames):
    """A stream over one parquet file per frame."""
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(folder)
    return (
        spark.readStream.schema(schema.LOG_EVENTS)
        .option("maxFilesPerTrigger", 1)
        .parquet(folder)
    )


def test_live_reports_equal_batch_over_several_batches(spark, tmp_path):
    all_logs = fixture.log_events(fixture.base_events(spark, SF)).select(
        *schema.LOG_EVENTS.fieldNames()
    )
    parts = [all_logs.filter(F.col("id") % 3 == part) for part in range(3)]
    stream = stored_stream(spark, str(tmp_path / "logs"), *parts)

    report = live.report_now(live.stream_tool_metrics(stream), str(tmp_path / "tools"))
    assert same(report, tools.tool_metrics(events.logged_tool_calls(all_logs)))

    seen = live.agents_seen(live.report_now(live.stream_sightings(stream), str(tmp_path / "agents")))
    expected = agents.agent_sightings(all_logs).groupBy("agent").agg(
        F.min("timestamp").alias("first_seen")
    )
    assert same(seen, expected)

    windows = live.report_now(
        live.stream_windows(stream, "1 hour", "20 minutes"), str(tmp_path / "windows")
    )
    per_call = windows.agg(F.sum("calls")).first()[0]
    assert per_call == 3 * events.logged_tool_calls(all_logs).count()


def test_delay_drops_late_events_only(spark, tmp_path):
    first = logs(spark, (*tool_result("t"), 0), (*tool_result("t"), 7200))
    late = logs(spark, (*tool_result("t"), 60), (*tool_result("t"), 7260))
    more = logs(spark, (*tool_result("t"), 100), (*tool_result("t"), 7300))

    def calls(delay, name):
        stream = stored_stream(spark, str(tmp_path / name), first, late, more)
        report = live.stream_windows(stream, "1 hour", delay=delay)
        out = str(tmp_path / f"{name}-out")
        query = (
            report.writeStream.outputMode("update")
            .foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}"))
            .option("checkpointLocation", str(tmp_path / f"{name}-checkpoint"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        newest = spark.read.parquet(out).groupBy("window_start").agg(F.max("calls").alias("n"))
        return [r.n for r in newest.orderBy("window_start").collect()]

    assert calls(None, "whole") == [3, 3]
    early, recent = calls("10 minutes", "cut")
    assert (early < 3, recent) == (True, 3)


def test_two_streams_and_a_fresh_checkpoint_keep_each_others_rows(spark, tmp_path):
    payloads = fixture.log_payloads(fixture.base_events(spark, SF)).select("payload").limit(2)
    source, root = str(tmp_path / "in"), str(tmp_path / "tables")
    payloads.write.text(source)
    counts = []
    for checkpoint in ("a", "b"):
        stream = ingest.payload_stream(spark, source)
        folder = str(tmp_path / checkpoint)
        ingest.start_ingest(stream, root, folder, "logs", availableNow=True).awaitTermination()
        counts.append(tables.read(spark, root, "log_events").count())
    assert counts[1] == 2 * counts[0] > 0


def test_a_delay_frees_state_and_keeps_the_last_state_of_each_window(spark, tmp_path):
    days = [logs(spark, (*tool_result("t"), day * 5 * 86400)) for day in range(3)]
    stream = stored_stream(spark, str(tmp_path / "logs"), *days)
    out = str(tmp_path / "out")
    query = live.start_changes(
        live.stream_windows(stream, "1 hour", delay="1 hour"),
        out,
        str(tmp_path / "checkpoint"),
        availableNow=True,
    )
    query.awaitTermination()
    held = [done["stateOperators"][0]["numRowsTotal"] for done in query.recentProgress]
    assert max(held) <= 2 and held[-1] == 1
    newest = live.newest_rows(spark, out, ["window_start", "window_end", "tool_name"])
    assert [r.calls for r in newest.collect()] == [1, 1, 1]


def test_changes_of_a_window_replace_each_other(spark, tmp_path):
    parts = [logs(spark, (*tool_result("t"), 0)), logs(spark, (*tool_result("t"), 60))]
    stream = stored_stream(spark, str(tmp_path / "logs"), *parts)
    out = str(tmp_path / "out")
    report = live.stream_windows(stream)
    live.start_changes(report, out, str(tmp_path / "c"), availableNow=True).awaitTermination()
    newest = live.newest_rows(spark, out, ["window_start", "window_end", "tool_name"])
    assert [r.calls for r in newest.collect()] == [2]


def test_a_report_without_new_input_is_the_last_one_and_old_ones_go(spark, tmp_path):
    parts = [logs(spark, (*tool_result("t"), place)) for place in range(4)]
    stream = stored_stream(spark, str(tmp_path / "logs"), *parts)
    report, folder = live.stream_tool_metrics(stream), str(tmp_path / "report")
    for _ in range(2):
        assert [r.call_count for r in live.report_now(report, folder).collect()] == [4]
    assert len(list((tmp_path / "report" / "out").glob("batch=*"))) == 2


def test_a_report_without_any_input_is_empty(spark, tmp_path):
    stream = stored_stream(spark, str(tmp_path / "logs"), logs(spark).limit(0))
    assert live.report_now(live.stream_api_by_model(stream), str(tmp_path / "report")).count() == 0


def test_a_request_may_span_the_lines_of_a_file(spark, tmp_path):
    request = {"resourceLogs": [{"scopeLogs": [{"logRecords": [{}, {}]}]}]}
    source, root = tmp_path / "in", str(tmp_path / "tables")
    source.mkdir()
    (source / "one.json").write_text(json.dumps(request, indent=2))
    stream = ingest.payload_stream(spark, str(source), whole_files=True)
    checkpoint = str(tmp_path / "checkpoint")
    ingest.start_ingest(stream, root, checkpoint, "logs", availableNow=True).awaitTermination()
    assert tables.read(spark, root, "log_events").count() == 2
    assert tables.read(spark, root, "bad_log_payloads").count() == 0


def test_closed_windows_are_written_once_and_leave_the_state(spark, tmp_path):
    days = [logs(spark, (*tool_result("t"), day * 86400), (*tool_result("u"), day * 86400 + 60)) for day in range(5)]
    stream = stored_stream(spark, str(tmp_path / "logs"), *days)
    windows = live.stream_windows(stream, delay="1 hour")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    query = live.start_closed(windows, out, checkpoint, availableNow=True)
    query.awaitTermination()
    held = [done["stateOperators"][0]["numRowsTotal"] for done in query.recentProgress]
    assert max(held) <= 4 and held[-1] == 2  # one or two days of windows, whatever came before
    closed = live.closed_windows(spark, out, windows.schema)
    keys = [(r.window_start, r.tool_name) for r in closed.collect()]
    assert len(keys) == len(set(keys)) == 8  # the last day is still open
    # A restart writes what has closed since, and nothing again.
    logs(spark, (*tool_result("t"), 9 * 86400)).coalesce(1).write.mode("append").parquet(str(tmp_path / "logs"))
    live.start_closed(windows, out, checkpoint, availableNow=True).awaitTermination()
    again = live.closed_windows(spark, out, windows.schema)
    assert again.count() == 10 and again.select("window_start", "tool_name").distinct().count() == 10


def test_late_calls_are_counted(spark, tmp_path):
    first = logs(spark, (*tool_result("t"), 0), (*tool_result("t"), 10 * 3600), (*tool_result("t"), 90000))
    wait = logs(spark, (*tool_result("t"), 90000))
    late = logs(spark, (*tool_result("t"), 60), (*tool_result("t"), 61), (*tool_result("u"), 10 * 3600), (*tool_result("t"), 90060))
    stream = stored_stream(spark, str(tmp_path / "logs"), first, wait, late)
    closed = live.closed_now(live.stream_windows(stream, delay="1 hour"), str(tmp_path / "closed"))
    assert closed.agg(F.sum("calls")).first()[0] == 2
    stored = first.unionByName(wait).unionByName(late)
    counted = live.late_calls(closed, events.logged_tool_calls(stored))
    assert sorted((r.tool_name, r.late) for r in counted.collect()) == [("t", 2), ("u", 1)]
    assert live.late_calls(closed, events.logged_tool_calls(first)).count() == 0
    assert live.late_calls(closed.limit(0), events.logged_tool_calls(stored)).count() == 0


def test_windows_over_two_sources_wait_for_the_slower(spark, tmp_path):
    fast = stored_stream(spark, str(tmp_path / "logs"), logs(spark, (*tool_result("t"), 0), (*tool_result("t"), 90000)))
    rows = [("t", True, 1, None, 60), ("t", True, 1, None, 7200)]
    legacy(spark, *rows).coalesce(1).write.parquet(str(tmp_path / "legacy"))
    slow = spark.readStream.schema(schema.TOOL_EVENTS).parquet(str(tmp_path / "legacy"))
    closed = live.closed_now(live.stream_unified_windows(slow, fast), str(tmp_path / "out"))
    assert [(r.calls, r.window_start.minute) for r in closed.collect()] == [(2, 0)]  # 7200 s less an hour
    key = "spark.sql.streaming.multipleWatermarkPolicy"
    spark.conf.set(key, "max")
    try:
        with pytest.raises(ValueError, match="policy"):
            live.stream_unified_windows(slow, fast)
    finally:
        spark.conf.set(key, "min")


def test_merged_changes_replace_the_ones_before(spark, tmp_path):
    parts = [logs(spark, (*tool_result(f"t{place % 3}"), place)) for place in range(9)]
    stream = stored_stream(spark, str(tmp_path / "logs"), *parts)
    out, keys = str(tmp_path / "out"), ["tool_name"]
    report = live.stream_tool_metrics(stream)
    query = live.start_changes(report, out, str(tmp_path / "c"), keys, merge_every=2, availableNow=True)
    query.awaitTermination()
    newest = live.newest_rows(spark, out, keys)
    assert sorted((r.tool_name, r.call_count) for r in newest.collect()) == [("t0", 3), ("t1", 3), ("t2", 3)]
    kept = sorted(int(p.name[6:]) for p in (tmp_path / "out").glob("batch=*"))
    assert kept == [5, 6, 7, 8]  # the last merge but one, and what came after it


def request(*seconds, model=None):
    records = []
    for second in seconds:
        name = "api_request" if model else "tool_result"
        values = {"event.name": name, "tool_name": "t", "duration_ms": str(second), "success": "true"}
        values |= {"model": model} if model else {}
        attributes = [{"key": k, "value": {"stringValue": v}} for k, v in values.items()]
        records.append({"timeUnixNano": str(int(at(second).timestamp() * 10**9)), "attributes": attributes})
    return json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": records}]}]})


def test_panes_of_a_range(spark, tmp_path):
    source, root, checkpoint = (str(tmp_path / name) for name in ("in", "tables", "checkpoint"))
    requests = [request(0, 30, 61, 90, 3600), request(5, 59, 61), request(70, 100, model="m"), "garbage"]
    for text in requests:
        spark.createDataFrame([(text,)], "payload string").coalesce(1).write.mode("append").text(source)
    stream = ingest.payload_stream(spark, source, files_per_batch=1)
    ingest.start_ingest(stream, root, checkpoint, "logs", panes=True, availableNow=True).awaitTermination()
    stored = tables.read(spark, root, "log_events")
    assert stored.count() == 10
    assert tables.read(spark, root, "tool_panes").count() == 5  # two, one and two minutes of three loads
    for since in (None, at(0), at(30), at(59.5), at(60), at(61), at(62), at(7200)):
        calls = events.logged_tool_calls(stored, since)
        assert same(panes.range_tool_metrics(spark, root, since), tools.tool_metrics(calls))
        assert panes.range_api_totals(spark, root, since).first() == api.api_totals(stored, since).first()
        assert same(panes.range_api_by_model(spark, root, since), api.api_by_model(stored, since))
    whole = panes.range_tool_metrics(spark, root, at(60))
    assert all("table=tool_panes" in f for f in whole.inputFiles())
    with pytest.raises(ValueError, match="logs"):
        ingest.start_ingest(stream, root, checkpoint, "metrics", panes=True)


def test_a_range_over_nothing(spark, tmp_path):
    assert panes.range_tool_metrics(spark, str(tmp_path), at(1)).count() == 0
    assert panes.range_api_totals(spark, str(tmp_path), at(1)).first().total_calls == 0
