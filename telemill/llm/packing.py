"""Batches of documents of similar length: optimal length buckets, filled up to a token budget."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.line_quality import word_array
from telemill.operators.ordering import with_position
from telemill.session import stored

BUCKETS = 16
TOKEN_BUDGET = 32768
# Lengths keep this many leading bits, rounded up; below 2**10 they are exact.
LENGTH_BITS = 10


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(word_array(text)), F.lit(0)).cast("bigint")


def _rounded(length: Column) -> Column:
    """The length with ``LENGTH_BITS`` leading bits, rounded up: 512 values an octave at most."""
    bits = F.length(F.bin(length))
    unit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(bits - LENGTH_BITS, F.lit(0)))
    return F.floor((length + unit - 1) / unit).cast("bigint") * unit


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets of ascending lengths that minimise padding.

    Dynamic programming over the histogram. With j lengths placed, the best
    cost of a last bucket that ends at length j and begins after length i is
    that of i with one bucket less, plus length j for each row between.
    """
    size = len(lengths)
    if not size:
        return []
    value = np.asarray(lengths, np.float64)
    before = np.concatenate(([0], np.cumsum(np.asarray(counts, np.float64))))
    best = np.concatenate(([0.0], np.full(size, np.inf)))
    choices = []
    for _ in range(min(buckets, size)):
        now, choice = np.full(size + 1, np.inf), np.zeros(size + 1, np.int64)
        now[0] = 0.0
        for j in range(1, size + 1):
            cost = best[:j] + value[j - 1] * (before[j] - before[:j])
            choice[j] = np.argmin(cost)
            now[j] = cost[choice[j]]
        best = now
        choices.append(choice)
    ends, j = [], size
    for choice in reversed(choices):
        if j:
            ends.append(int(lengths[j - 1]))
            j = int(choice[j])
    return ends[::-1]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    budget: int = TOKEN_BUDGET,
) -> DataFrame:
    """Bucket and batch of each document: ``doc_id, n_tokens, bucket, padded_to, batch, slot``.

    Tokens are words. Bucket ends are optimal for the histogram of all lengths,
    which comes to the driver rounded to 10 leading bits, so its size is
    bounded whatever the table. A batch takes rows of one bucket, in order of
    id and length, while their padded lengths fit the budget; a document longer
    than the budget is a batch of its own. Null and empty texts have no tokens
    and are packed too. Ids may be null (they come first) or repeated; other
    columns are not looked at. An empty table gives an empty result.

    Rows are numbered by a range-partitioned sort, so a bucket with most of the
    rows is spread over tasks.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), n_words(F.col(f"`{text_col}`")).alias("n_tokens"))
    rows = stored(rows.withColumn("_length", _rounded(F.col("n_tokens"))), "lengths")
    histogram = sorted(
        (r["_length"], r["n"]) for r in rows.groupBy("_length").agg(F.count("*").alias("n")).collect()
    )
    ends = boundaries([h[0] for h in histogram], [h[1] for h in histogram], buckets)
    ends = ends or [0]
    sizes = [sum(n for length, n in histogram if low < length <= end) for low, end in zip([-1, *ends], ends)]
    first = np.concatenate(([0], np.cumsum(sizes))).tolist()
    capacity = [max(1, budget // max(end, 1)) for end in ends]

    def of_bucket(values: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("bigint") for v in values]), F.col("bucket") + 1)

    ended = F.array(*[F.lit(end).cast("bigint") for end in ends])
    bucket = F.size(F.filter(ended, lambda end: end < F.col("_length")))
    placed = with_position(
        rows.withColumn("bucket", bucket).drop("_length"),
        [F.col("bucket"), F.col("doc_id").asc_nulls_first(), F.col("n_tokens")],
    )
    place = F.col("position") - 1 - of_bucket(first[:-1])
    return placed.select(
        "doc_id",
        "n_tokens",
        "bucket",
        of_bucket(ends).alias("padded_to"),
        F.floor(place / of_bucket(capacity)).cast("bigint").alias("batch"),
        (place % of_bucket(capacity)).cast("bigint").alias("slot"),
    )


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """Batches of all documents."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
