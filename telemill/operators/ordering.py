"""Sorted reports, and positions in them without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.session import stored

# Sort keys of the tool report and the column behind each.
SORT_COLUMNS = {
    "calls": "call_count",
    "last_call": "last_call",
    "avg_duration": "avg_duration_ms",
    "name": "tool_name",
}


def sort_keys(by: str = "calls", ascending: bool = False) -> list[Column]:
    """Sort expressions; ties go by name upwards, and a missing value is the smallest."""
    column = F.col(SORT_COLUMNS[by])
    primary = column.asc_nulls_first() if ascending else column.desc_nulls_last()
    return [primary] if by == "name" else [primary, F.col("tool_name").asc()]


def rank_tools(metrics: DataFrame, by: str = "calls", ascending: bool = False) -> DataFrame:
    """The tool report in the asked-for order."""
    return metrics.orderBy(*sort_keys(by, ascending))


def with_position(table: DataFrame, keys: Sequence[Column], name: str = "position") -> DataFrame:
    """Number the rows 1..n in a total order.

    The range-partitioned sort is kept on disk once. A row's position is its
    place in its partition plus the rows of the partitions before it; only
    those counts, one per partition, meet in one task.
    """
    local_bits = 33  # monotonically_increasing_id: partition above, row number below
    numbered = stored(
        table.orderBy(*keys).withColumn("_row", F.monotonically_increasing_id()), "positions"
    ).withColumns(
        {
            "_part": F.shiftright("_row", local_bits),
            "_local": F.col("_row").bitwiseAND(F.lit(2**local_bits - 1)),
        }
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    # One row per shuffle partition of the sort, so broadcasting it is bounded.
    return (
        numbered.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_local") + 1)
        .drop("_part", "_row", "_local", "_offset")
    )
