"""The few file operations that the table set needs, on whatever store Hadoop can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _store(spark: SparkSession, path):
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def matching(spark: SparkSession, pattern: str) -> list:
    """Status of all files and folders that a pattern matches, in order of their paths."""
    path = _path(spark, pattern)
    return list(_store(spark, path).globStatus(path) or [])


def names(spark: SparkSession, pattern: str) -> list[str]:
    return [status.getPath().getName() for status in matching(spark, pattern)]


def status_of(spark: SparkSession, path: str):
    place = _path(spark, path)
    return _store(spark, place).getFileStatus(place)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, if it is there."""
    place = _path(spark, path)
    _store(spark, place).delete(place, True)


def size(spark: SparkSession, folder: str) -> int:
    """Bytes below a folder."""
    path = _path(spark, folder)
    return _store(spark, path).getContentSummary(path).getLength()


def write_whole(spark: SparkSession, path: str, text: str, replace: bool = False) -> None:
    """A small file that others see whole or not at all; a new one, unless it may replace one."""
    place, draft = _path(spark, path), _path(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    store = _store(spark, place)
    stream = store.create(draft, False)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    if replace:
        store.delete(place, False)
    if not store.rename(draft, place):
        store.delete(draft, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file."""
    place = _path(spark, path)
    stream = _store(spark, place).open(place)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def escaped(spark: SparkSession, value: str) -> str:
    """A partition value as it stands in a folder name."""
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def unescaped(spark: SparkSession, name: str) -> str:
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name)
