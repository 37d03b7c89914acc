"""Connected components of a link table, by rounds of joins on stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.session import stored


def _checksum(links: DataFrame) -> tuple:
    # exact sums, so that they cannot overflow
    return tuple(
        links.agg(F.count("*"), F.sum(F.xxhash64("node", "low").cast("decimal(38,0)"))).first()
    )


def connected(links: DataFrame) -> DataFrame:
    """``node, component`` for links ``a, b``: the smallest node that each node reaches.

    Large-star and small-star steps in turn: every node hands its larger, then
    its smaller neighbours over to the smallest one it knows, until all links
    are stars. The neighbours' minimum is combined before the shuffle, and a
    node with very many neighbours is only a skewed join key, which adaptive
    execution splits. A link of a node with itself, or with null, says nothing.
    Nodes without links are not in the result.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    links = links.where("a <> b").select(high.alias("node"), low.alias("low")).distinct()
    links = stored(links, "links")
    seen = _checksum(links)
    while seen[0]:
        both = links.union(links.select("low", "node"))
        least = both.groupBy("node").agg(F.min("low").alias("m"))
        large = (
            both.where("low > node")
            .join(least, "node")
            .select(F.col("low").alias("node"), F.least("m", "node").alias("low"))
            .distinct()
        )
        least = large.groupBy("node").agg(F.min("low").alias("m"))
        small = large.join(least, "node").select(
            F.when(F.col("low") == F.col("m"), F.col("node")).otherwise(F.col("low")).alias("node"),
            F.col("m").alias("low"),
        )
        links = stored(small.distinct(), "links")
        before, seen = seen, _checksum(links)
        if before == seen:
            break
    return links.groupBy("node").agg(F.min("low").alias("component"))
