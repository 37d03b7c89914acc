from __future__ import annotations

import glob
import json
from datetime import date, timedelta

from pyspark.sql import functions as F

from telemill import files, schema
from telemill.operators import events, tools
from telemill.plans import fixture
from telemill.session import freed_folders, new_folder, stored
from telemill.sources import tables
from telemill.sources.commits import load_of, read_commits
from tests.helpers import START, by, legacy, logs, tool_result

SF = "/root/testdata/sf0.001"


def count(spark, root, table):
    return tables.read(spark, root, table).count()


def test_missing_tables_are_empty(spark, tmp_path):
    for table, columns in schema.TABLES.items():
        frame = tables.read(spark, str(tmp_path / "none"), table)
        assert frame.count() == 0
        assert set(columns.fieldNames()) <= set(frame.columns)


def test_tables_come_back_as_written(spark, tmp_path):
    base = fixture.base_events(spark, SF)
    for name, build in fixture.TABLES.items():
        written = build(base).select(*schema.TABLES[name].fieldNames())
        tables.append(written, str(tmp_path), name, "one")
        stored = tables.read(spark, str(tmp_path), name).select(*written.columns)
        if name == "log_events":  # maps do not compare
            entries = F.array_sort(F.map_entries("attributes")).cast("string")
            written, stored = (f.withColumn("attributes", entries) for f in (written, stored))
        assert stored.exceptAll(written).count() == 0
        assert written.exceptAll(stored).count() == 0


def test_a_load_repeated_replaces_itself(spark, tmp_path):
    root = str(tmp_path)
    rows = logs(spark, tool_result("a"), tool_result("b"), ("api_request", {}), (None, {}))
    for load in ("one", "two", "one"):
        tables.append(rows, root, "log_events", load)
    assert count(spark, root, "log_events") == 8


def test_reports_read_promoted_columns_only(spark, tmp_path):
    root = str(tmp_path)
    tables.append(logs(spark, tool_result("a"), ("api_request", {})), root, "log_events", "one")
    stored = tables.read(spark, root, "log_events")
    metrics = tools.tool_metrics(events.logged_tool_calls(stored, START))
    assert by(metrics, "tool_name")["a"].call_count == 1
    plan = metrics._jdf.queryExecution().executedPlan().toString()
    assert "attributes" not in plan
    partition_filters = plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert "event_family" in partition_filters and "event_date" in partition_filters
    assert "GreaterThanOrEqual(timestamp" in plan


def test_map_and_promoted_columns_agree(spark, tmp_path):
    base = fixture.base_events(spark, SF)
    plain = fixture.log_events(base).select(*schema.LOG_EVENTS.fieldNames())
    root = str(tmp_path)
    tables.append(plain, root, "log_events", "one")
    old = fixture.tool_events(base)
    from_map = tools.tool_metrics(events.unified_tool_events(old, plain))
    stored = tables.read(spark, root, "log_events")
    from_columns = tools.tool_metrics(events.unified_tool_events(old, stored))
    assert from_map.exceptAll(from_columns).count() == 0
    errors_map = events.last_errors(events.tool_errors(old, plain))
    errors_columns = events.last_errors(events.tool_errors(old, stored))
    assert errors_map.exceptAll(errors_columns).count() == 0


def test_attributes_as_json_text(spark, tmp_path):
    rows = logs(spark, tool_result("a", "false", "7", error='say "no"'), ("tool_result", {}))
    text = rows.withColumn("attributes", F.to_json("attributes"))
    expected = tools.tool_metrics(events.logged_tool_calls(rows))
    assert tools.tool_metrics(events.logged_tool_calls(text)).exceptAll(expected).count() == 0
    tables.append(text, str(tmp_path), "log_events", "one")
    stored = tables.read(spark, str(tmp_path), "log_events").filter("attr_tool_name = 'a'").first()
    assert stored.attributes["error"] == stored.attr_error == 'say "no"'


def test_prune_drops_whole_days(spark, tmp_path):
    root = str(tmp_path)
    days = [(*tool_result("t"), -86400 * back) for back in range(10)]
    tables.append(logs(spark, *days), root, "log_events", "one")
    old = [("t", True, 1, None, -86400 * back) for back in range(10)]
    tables.append(legacy(spark, *old), root, "tool_events", "one")
    deleted = tables.prune(spark, root, START)
    assert len(deleted) == 4  # two days in two tables
    assert count(spark, root, "log_events") == 8
    kept = tables.retained(tables.read(spark, root, "log_events"), START + timedelta(seconds=1))
    assert kept.count() == 7
    assert tables.prune(spark, root, START) == []
    first = tables.read(spark, root, "tool_events").agg(F.min("event_date")).first()[0]
    assert first == date(2024, 1, 3)


def test_payloads_and_quarantine_in_one_load(spark, tmp_path):
    record = {
        "timeUnixNano": "1704888000000000000",
        "attributes": [
            {"key": "event.name", "value": {"stringValue": "x.tool_result"}},
            {"key": "tool_name", "value": {"stringValue": "Read"}},
        ],
    }
    good = json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [record, {}]}]}]})
    payloads = spark.createDataFrame(
        [(good, START), ("garbage", START)], "payload string, ingest_ts timestamp"
    )
    root = str(tmp_path)
    for _ in range(2):
        tables.append_log_payloads(payloads, root, "one")
    stored = tables.read(spark, root, "log_events")
    assert sorted((r.event_family or "", r.attr_tool_name or "") for r in stored.collect()) == [
        ("", ""),
        ("tool_result", "Read"),
    ]
    assert [r.payload for r in tables.read(spark, root, "bad_log_payloads").collect()] == ["garbage"]

    points = [{"asInt": "5"}, {"asInt": 6}]
    metrics = [
        {"name": "claude_code.token.usage", "sum": {"dataPoints": points}},
        {"name": "claude_code.cost.usage", "sum": {"dataPoints": [{"asDouble": 0.5}]}},
        {"name": "claude_code.commit.count", "sum": {"dataPoints": [{"asInt": 2}]}},
        {"name": "unknown.metric", "sum": {"dataPoints": [{"asInt": 2}]}},
    ]
    good = json.dumps({"resourceMetrics": [{"scopeMetrics": [{"metrics": metrics}]}]})
    payloads = spark.createDataFrame(
        [(good, START), ("garbage", START)], "payload string, ingest_ts timestamp"
    )
    tables.append_metric_payloads(payloads, root, "one")
    assert sorted(r["count"] for r in tables.read(spark, root, "token_usage").collect()) == [5, 6]
    assert [r.cost_usd for r in tables.read(spark, root, "cost_usage").collect()] == [0.5]
    assert [r.metric_name for r in tables.read(spark, root, "session_metrics").collect()] == ["commit"]
    assert count(spark, root, "bad_metric_payloads") == 1


def test_a_hot_day_is_split_into_files(spark, tmp_path):
    """All rows in one day and family still leave through several tasks."""
    rows = spark.range(200_000).select(
        "id",
        F.lit(START).cast("timestamp").alias("timestamp"),
        F.lit("tool_result").alias("event_name"),
        F.sha2(F.col("id").cast("string"), 512).alias("body"),
        F.create_map(F.lit("tool_name"), F.lit("Read")).alias("attributes"),
    )
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "1m")
    try:
        tables.append(rows, str(tmp_path), "log_events", "one")
    finally:
        spark.conf.set(key, before)
    files = glob.glob(f"{tmp_path}/table=log_events/*/*/*/*.parquet")
    assert len(files) > 3
    assert count(spark, str(tmp_path), "log_events") == 200_000


def test_a_load_run_again_leaves_none_of_its_old_rows(spark, tmp_path):
    root = str(tmp_path)
    first = logs(spark, (*tool_result("a"), 0), (*tool_result("b"), 86400))
    moved = logs(spark, (*tool_result("a"), 2 * 86400))
    tables.append(first, root, "log_events", "2024-01-10T12:00")
    tables.append(first, root, "log_events", "other")
    tables.append(legacy(spark, ("a", True, 1, None)), root, "tool_events", "2024-01-10T12:00")
    tables.append(moved, root, "log_events", "2024-01-10T12:00")
    loads = tables.scan(spark, root, "log_events").where(F.col("load_id").isin(*read_commits(spark, root).attempts["log_events"]))
    counts = {load_of(r.load_id): r["count"] for r in loads.groupBy("load_id").count().collect()}
    assert counts == {"2024-01-10T12:00": 1, "other": 2}
    assert count(spark, root, "tool_events") == 1
    tables.append(moved.limit(0), root, "log_events", "2024-01-10T12:00")
    assert count(spark, root, "log_events") == 2


def test_folders_go_when_their_work_is_done(spark):
    outer = new_folder(spark, "kept")
    spark.range(1).write.parquet(outer)
    with freed_folders():
        inner = stored(spark.range(3), "inner").inputFiles()[0].rpartition("/")[0]
        assert files.matching(spark, inner)
    assert files.matching(spark, outer) and not files.matching(spark, inner)
