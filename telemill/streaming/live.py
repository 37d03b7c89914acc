"""Reports kept up to date on streams.

The all-time reports are the batch functions applied to a stream. State is one
row per tool or agent, built from partial sums, so a hot tool does not weigh on
one task. Nothing is late: without a delay given, no row is dropped.

Whole reports (``start_report``) keep their state; windows with a delay free it
when only their changes are written (``start_changes``), or when each window is
written once, after it has closed (``start_closed``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from telemill import files
from telemill.fixed_values import AGENTS, Agent
from telemill.operators import usage
from telemill.operators.agents import agents_of_names, telling_names
from telemill.operators.api import api_by_model, api_totals
from telemill.operators.events import (
    legacy_tool_calls,
    logged_tool_calls,
    logged_tool_errors,
    newest_errors,
    tool_errors,
)
from telemill.operators.tools import tool_metrics


def stream_tool_metrics(logs: DataFrame) -> DataFrame:
    """The tool report over all log events so far."""
    return tool_metrics(logged_tool_calls(logs))


def stream_unified_tool_metrics(legacy: DataFrame, logs: DataFrame) -> DataFrame:
    """The tool report over both event tables as they grow; a call present in both counts twice."""
    return tool_metrics(legacy_tool_calls(legacy).unionByName(logged_tool_calls(logs)))


def stream_last_errors(logs: DataFrame) -> DataFrame:
    """Newest error of every tool over all log events so far."""
    return newest_errors(logged_tool_errors(logs))


def stream_unified_last_errors(legacy: DataFrame, logs: DataFrame) -> DataFrame:
    """Newest error of every tool over both event tables as they grow."""
    return newest_errors(tool_errors(legacy, logs))


def stream_api_by_model(logs: DataFrame) -> DataFrame:
    """Calls and mean latency per model so far."""
    return api_by_model(logs)


def stream_api_totals(logs: DataFrame) -> DataFrame:
    """Calls, errors and mean latency so far: one row."""
    return api_totals(logs)


def stream_tokens_by_type(tokens: DataFrame) -> DataFrame:
    """Tokens per type so far."""
    return usage.tokens_by_type(tokens)


def stream_token_totals(tokens: DataFrame, agents: Sequence[Agent] = AGENTS) -> DataFrame:
    """Tokens of each class so far: one row.

    Types are looked up in a small table before the only aggregation, since a
    whole report takes one aggregation at most.
    """
    return usage.classified_totals(tokens, agents)


def stream_session_metrics(metrics: DataFrame) -> DataFrame:
    """Lines of code, commits and active seconds so far: one row."""
    return usage.session_totals(metrics)


def stream_cost_total(costs: DataFrame) -> DataFrame:
    """Cost in all so far."""
    return usage.cost_total(costs)


def stream_session_by_name(metrics: DataFrame) -> DataFrame:
    """Signed sum per session metric so far."""
    return usage.session_by_name(metrics)


def tool_windows(calls: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Calls and errors per tool and time window, of a batch or a stream."""
    window = F.window("timestamp", size, slide) if slide else F.window("timestamp", size)
    return (
        calls.groupBy(window.alias("window"), "tool_name")
        .agg(
            F.count("*").alias("calls"),
            F.count_if(~F.col("success")).alias("errors"),
            F.avg("duration_ms").alias("avg_duration_ms"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "tool_name",
            "calls",
            "errors",
            "avg_duration_ms",
        )
    )


def stream_windows(
    logs: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str | None = None
) -> DataFrame:
    """Calls and errors per tool and time window.

    With a ``delay``, and written by ``start_changes`` or ``start_closed``, the
    state of a window is dropped once events are that much later than its end,
    and events later still are not counted; ``late_calls`` tells how many.
    """
    calls = logged_tool_calls(logs)
    if delay is not None:
        calls = calls.withWatermark("timestamp", delay)
    return tool_windows(calls, size, slide)


def stream_unified_windows(
    legacy: DataFrame,
    logs: DataFrame,
    size: str = "1 hour",
    slide: str | None = None,
    legacy_delay: str = "1 hour",
    logs_delay: str = "1 hour",
) -> DataFrame:
    """Windows over both event tables, each with a delay of its own.

    Windows close by the slower of the two: the session has to keep to the
    policy of the least watermark, else the faster source would make rows of
    the other late.
    """
    policy = logs.sparkSession.conf.get("spark.sql.streaming.multipleWatermarkPolicy")
    if policy != "min":
        raise ValueError(f"windows over two sources need the watermark policy min, not {policy}")
    old = legacy_tool_calls(legacy).withWatermark("timestamp", legacy_delay)
    return tool_windows(old.unionByName(logged_tool_calls(logs).withWatermark("timestamp", logs_delay)), size, slide)


def stream_sightings(logs: DataFrame, agents: Sequence[Agent] = AGENTS) -> DataFrame:
    """Tools and models that give an agent away so far, with the agent and the time of first sight.

    State is a row per name; the rules for names are applied to these, not to
    events. ``agents_seen`` makes one row per agent of it.
    """
    first = telling_names(logs).groupBy("tool_name", "model").agg(F.min("timestamp").alias("first_seen"))
    return agents_of_names(first, agents)


def agents_seen(sightings: DataFrame) -> DataFrame:
    """Agents seen so far, with the time of first sight."""
    return sightings.groupBy("agent").agg(F.min("first_seen").alias("first_seen"))


def _batches(spark: SparkSession, folder: str) -> dict[int, str]:
    """Folders of the batches that are written whole, by their number."""
    done = [status.getPath().getParent() for status in files.matching(spark, f"{folder}/batch=*/_SUCCESS")]
    return {int(path.getName().removeprefix("batch=")): path.toString() for path in done}


def _write_batch(folder: str):
    def write(result: DataFrame, batch: int) -> None:
        result.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return write


def _replace_batch(folder: str):
    def write(result: DataFrame, batch: int) -> None:
        _write_batch(folder)(result, batch)
        # The report before stays, since it may be being read.
        for number, place in _batches(result.sparkSession, folder).items():
            if number < batch - 1:
                files.delete(result.sparkSession, place)

    return write


def _start(report: DataFrame, mode: str, write, checkpoint: str, trigger: dict) -> StreamingQuery:
    writer = (
        report.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(**trigger) if trigger else writer).start()


def start_report(
    report: DataFrame, folder: str, checkpoint: str, **trigger: object
) -> StreamingQuery:
    """Write the whole report to ``<folder>/batch=<n>`` after every micro-batch.

    The newest report and the one before it are kept.
    """
    return _start(report, "complete", _replace_batch(folder), checkpoint, trigger)


def start_closed(
    windows: DataFrame, folder: str, checkpoint: str, **trigger: object
) -> StreamingQuery:
    """Write each window of a report with a delay once, when it has closed, to ``<folder>/batch=<n>``.

    State holds open windows only, and a row never changes once it is written;
    a batch that is run again replaces itself. ``closed_windows`` reads them.
    """
    return _start(windows, "append", _write_closed(folder), checkpoint, trigger)


def _write_closed(folder: str):
    write = _write_batch(folder)

    def write_some(result: DataFrame, batch: int) -> None:
        # Most batches close no window; without a file of theirs there is less to list.
        result = result.persist()
        try:
            if not result.isEmpty():
                write(result, batch)
        finally:
            result.unpersist()

    return write_some


def closed_windows(spark: SparkSession, folder: str, schema: str | T.StructType) -> DataFrame:
    """All windows that ``start_closed`` has written."""
    batches = _batches(spark, folder)
    if not batches:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[batches[n] for n in sorted(batches)])


def late_calls(closed: DataFrame, calls: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """How many of the stored calls came too late for their closed window, per window and tool.

    ``closed`` are windows as written, ``calls`` all calls that are stored. A
    window counts as closed up to the last one written; tools whose calls were
    all late are in the result as well. Rows without late calls are left out.
    """
    closed_until = closed.agg(F.max("window_end")).scalar()
    whole = tool_windows(calls, size, slide).select("window_start", "window_end", "tool_name", "calls")
    whole = whole.where(F.col("window_end") <= closed_until)
    counted = closed.select("window_start", "tool_name", F.col("calls").alias("counted"))
    late = F.col("calls") - F.coalesce("counted", F.lit(0))
    return (
        whole.join(counted, ["window_start", "tool_name"], "left")
        .select("window_start", "window_end", "tool_name", late.alias("late"))
        .where("late > 0")
    )


def start_changes(
    report: DataFrame,
    folder: str,
    checkpoint: str,
    keys: Sequence[str] | None = None,
    merge_every: int = 50,
    **trigger: object,
) -> StreamingQuery:
    """Write the rows that a micro-batch changed to ``<folder>/batch=<n>``; see ``newest_rows``.

    With the ``keys`` of the report, every so many batches are merged into one
    that holds the last state of each row, and the ones before it are deleted
    when the next merge is done, so the folder does not grow with the changes.
    """
    write = _write_batch(folder) if keys is None else _write_merging(folder, keys, merge_every)
    return _start(report, "update", write, checkpoint, trigger)


_MERGED = "merged"  # marks a batch that holds all rows up to it


def _write_merging(folder: str, keys: Sequence[str], merge_every: int):
    def write(result: DataFrame, batch: int) -> None:
        if (batch + 1) % merge_every:
            _write_batch(folder)(result, batch)
            return
        spark = result.sparkSession
        earlier = {n: place for n, place in _since_merge(spark, folder).items() if n < batch}
        rows = result.withColumn("batch", F.lit(batch))
        for number, place in earlier.items():
            rows = rows.unionByName(spark.read.schema(result.schema).parquet(place).withColumn("batch", F.lit(number)))
        _newest(rows, keys).write.mode("overwrite").parquet(f"{folder}/batch={batch}")
        files.write_whole(spark, f"{folder}/_{_MERGED}/{batch}", "", replace=True)
        # The files before the merge before this one have no reader any more.
        merges = sorted(int(n) for n in files.names(spark, f"{folder}/_{_MERGED}/*") if not n.startswith("."))
        for number, place in _batches(spark, folder).items():
            if len(merges) > 1 and number < merges[-2]:
                files.delete(spark, place)

    return write


def _since_merge(spark: SparkSession, folder: str) -> dict[int, str]:
    """The last merge and the batches after it, or all batches."""
    merges = [int(n) for n in files.names(spark, f"{folder}/_{_MERGED}/*") if not n.startswith(".")]
    first = max(merges, default=0)
    return {number: place for number, place in _batches(spark, folder).items() if number >= first}


def _newest(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    names = [name for name in changes.columns if name not in (*keys, "batch")]
    return (
        changes.groupBy(*keys)
        .agg(F.max_by(F.struct(*names), "batch").alias("newest"))
        .select(*keys, "newest.*")
    )


def newest_rows(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """The last state of each row that ``start_changes`` has written, by its keys."""
    places = _since_merge(spark, folder)
    return _newest(spark.read.option("basePath", folder).parquet(*places.values()), keys)


def report_now(report: DataFrame, folder: str) -> DataFrame:
    """Run a streaming report over all input there is and return its last state.

    Called again on the same folder, it takes what is new, if anything.
    """
    query = start_report(report, f"{folder}/out", f"{folder}/checkpoint", availableNow=True)
    query.awaitTermination()
    spark = report.sparkSession
    batches = _batches(spark, f"{folder}/out")
    if not batches:
        return spark.createDataFrame([], report.schema)
    return spark.read.schema(report.schema).parquet(batches[max(batches)])


def closed_now(windows: DataFrame, folder: str) -> DataFrame:
    """Run windows with a delay over all input there is and return those that have closed so far."""
    query = start_closed(windows, f"{folder}/out", f"{folder}/checkpoint", availableNow=True)
    query.awaitTermination()
    return closed_windows(windows.sparkSession, f"{folder}/out", windows.schema)
