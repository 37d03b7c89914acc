"""Small hand-made tables."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession

from telemill import schema

START = datetime(2024, 1, 10, 12, 0, 0, tzinfo=timezone.utc)


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


def logs(spark: SparkSession, *events) -> DataFrame:
    """Events given as (name, attributes) or (name, attributes, seconds)."""
    rows = []
    for place, (name, attributes, *seconds) in enumerate(events):
        moment = at(seconds[0] if seconds else place)
        rows.append((place, moment, name, None, attributes))
    return spark.createDataFrame(rows, schema.LOG_EVENTS)


def tool_result(tool, success="true", duration="10", name="tool_result", **more):
    attributes = {"tool_name": tool, "success": success, "duration_ms": duration, **more}
    return name, {key: value for key, value in attributes.items() if value is not None}


def legacy(spark: SparkSession, *rows) -> DataFrame:
    """Rows given as (tool, success, duration, error) or with seconds behind."""
    data = []
    for place, (tool, success, duration, error, *seconds) in enumerate(rows):
        data.append((place, at(seconds[0] if seconds else place), tool, success, duration, error))
    return spark.createDataFrame(data, schema.TOOL_EVENTS)


def table(spark: SparkSession, name: str, *rows) -> DataFrame:
    """Rows of a metric table without id and time, which count up."""
    data = [(place, at(place), *row) for place, row in enumerate(rows)]
    return spark.createDataFrame(data, schema.TABLES[name])


def by(frame: DataFrame, key: str) -> dict:
    return {row[key]: row for row in frame.collect()}


def utc(moment: datetime) -> datetime:
    """A collected timestamp as an aware UTC time."""
    return moment.astimezone(timezone.utc)
