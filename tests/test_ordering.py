from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from telemill.operators import ordering

ROWS = [
    ("BBB", 2, datetime(2024, 1, 2), 5.0),
    ("AAA", 1, datetime(2024, 1, 3), 7.0),
    ("CCC", 3, None, 5.0),
    ("ccc", 3, datetime(2024, 1, 1), 1.0),
]
COLUMNS = "tool_name string, call_count bigint, last_call timestamp, avg_duration_ms double"


@pytest.mark.parametrize(
    "by, ascending, expected",
    [
        ("calls", False, ["CCC", "ccc", "BBB", "AAA"]),
        ("calls", True, ["AAA", "BBB", "CCC", "ccc"]),
        ("last_call", False, ["AAA", "BBB", "ccc", "CCC"]),
        ("last_call", True, ["CCC", "ccc", "BBB", "AAA"]),
        ("avg_duration", False, ["AAA", "BBB", "CCC", "ccc"]),
        ("avg_duration", True, ["ccc", "BBB", "CCC", "AAA"]),
        ("name", False, ["ccc", "CCC", "BBB", "AAA"]),
        ("name", True, ["AAA", "BBB", "CCC", "ccc"]),
    ],
)
def test_orders(spark, by, ascending, expected):
    metrics = spark.createDataFrame(ROWS, COLUMNS)
    assert [r.tool_name for r in ordering.rank_tools(metrics, by, ascending).collect()] == expected


def test_positions_across_partitions(spark):
    table = spark.range(5000, numPartitions=7).select(
        F.xxhash64("id").alias("key"), F.col("id").alias("tool_name")
    )
    # One value holds a third of the rows; the second key spreads it.
    table = table.withColumn("key", F.when(F.col("tool_name") % 3 == 0, 0).otherwise(F.col("key")))
    numbered = ordering.with_position(table, [F.desc("key"), F.asc("tool_name")]).collect()
    expected = sorted(((r.key, r.tool_name) for r in numbered), key=lambda r: (-r[0], r[1]))
    found = [(r.key, r.tool_name) for r in sorted(numbered, key=lambda r: r.position)]
    assert found == expected
    assert sorted(r.position for r in numbered) == list(range(1, 5001))
