"""Continuous ingest of payload files into the table set."""

from __future__ import annotations

import json
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from telemill.session import prepare_session
from telemill.sources.tables import append_log_payloads, append_metric_payloads

_APPEND = {"logs": append_log_payloads, "metrics": append_metric_payloads}


def payload_stream(
    spark: SparkSession,
    folder: str,
    files_per_batch: int | None = None,
    whole_files: bool = False,
) -> DataFrame:
    """Payloads of a folder of text files as they arrive.

    Each line is one request or, with ``whole_files``, each file, whose request
    may then span lines. A payload's arrival time is the time of its micro-batch, which the checkpoint
    keeps, so a repeated batch gives the same rows.
    """
    reader = prepare_session(spark).readStream
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(folder, wholetext=whole_files).select(
        F.col("value").alias("payload"), F.current_timestamp().alias("ingest_ts")
    )


def _append_batch(
    payloads: DataFrame, batch: int, signal: str, root: str, name: str, checkpoint: str, **options: object
) -> None:
    # The checkpoint names its stream; no other stream and no fresh checkpoint has that id.
    stream = json.loads(payloads.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]
    _APPEND[signal](payloads, root, f"{name}-{stream}-{batch:012d}", **options)


def start_ingest(
    payloads: DataFrame,
    root: str,
    checkpoint: str,
    signal: str,
    name: str = "stream",
    panes: bool = False,
    **trigger: object,
) -> StreamingQuery:
    """Append ``logs`` or ``metrics`` payloads of a stream to the tables.

    Each micro-batch is one load named after the stream's checkpoint and the
    batch, so streams never replace each other's loads: if it is run again after
    a failure it replaces its own files, so every payload is stored once.
    Several streams may write to one root at once. With ``panes``, logs also keep the partials that
    ``streaming.panes`` merges. ``trigger`` is passed on, such as ``availableNow=True``.
    """
    if panes and signal != "logs":
        raise ValueError("panes are kept of logs")
    options = {"panes": True} if panes else {}
    append = partial(
        _append_batch, signal=signal, root=root, name=f"{name}-{signal}", checkpoint=checkpoint, **options
    )
    writer = payloads.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
