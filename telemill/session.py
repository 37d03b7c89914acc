"""Session settings the jobs rely on, and where they may keep data on disk."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from telemill import files

# SQL settings that change results, so every job fixes them.
RESULT_SETTINGS = {
    # OTLP times are UTC; event_date partitions are cut at UTC midnight.
    "spark.sql.session.timeZone": "UTC",
    # A repeated attribute key keeps its last value instead of failing the job.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

_made: list[str] = []


def prepare_session(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings that results depend on and return the session."""
    for key, value in RESULT_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``, else one in the warehouse.

    A warehouse on a disk of one machine will do for a local session only.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_intermediate"
        if folder.startswith(("file:", "/")) and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses; it goes when the process ends."""
    folder = f"{shared_folder(spark)}/telemill/{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(remove_folders)
    _made.append(folder)
    return folder


def remove_folders(since: int = 0) -> None:
    """Delete the folders that :func:`new_folder` has named in this process, all or the latest.

    Results are read lazily, so their folders have to stay until the last of
    them has been used; a long-lived process calls this between jobs.
    """
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    while len(_made) > since:
        files.delete(spark, _made.pop())


@contextmanager
def freed_folders() -> Iterator[None]:
    """Delete the folders that are named inside when it ends: for work whose result is written elsewhere."""
    before = len(_made)
    try:
        yield
    finally:
        remove_folders(before)


def stored(table: DataFrame, label: str) -> DataFrame:
    """Write an intermediate once to the shared folder and read it from there.

    Cuts the lineage with one computation of the table, and survives the loss
    of any executor.
    """
    folder = new_folder(table.sparkSession, label)
    table.write.parquet(folder)
    return table.sparkSession.read.schema(table.schema).parquet(folder)
