"""Exact deduplication against a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm.words import plain
from telemill.session import new_folder, stored


class DigestIndex:
    """A table ``digest, keep_id, group_size, load`` at a path, kept across sessions.

    Files are bucketed and sorted by digest, so that the index is never
    shuffled: new digests come to its buckets. A bucket of several loads has as
    many sorted files, which Spark sorts as one when it reads them. ``buckets``
    is fixed when the index is made; aim at some hundred MB a bucket.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"create table {self.name} (digest binary, keep_id bigint, group_size bigint, load string) "
            f"using parquet clustered by (digest) sorted by (digest) into {buckets} buckets "
            f"location '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        rows = rows.select("digest", "keep_id", "group_size", "load").repartition(self.buckets, "digest")
        rows.write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def close(self) -> None:
        """Forget the name of the table; its files stay."""
        self.spark.sql(f"drop table {self.name}")


def add_documents(
    docs: DataFrame, index: DigestIndex, load: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Add a load to the index: ``doc_id, keep_id, group_size, kept, text_sha256``, a row for each row.

    Of the rows of the load that have the same text, the one with the largest
    id stays, unless an earlier load brought the text: then none does and
    ``keep_id`` is the row that stayed there. ``group_size`` counts the rows
    that had the text in the load that brought it. A load that is added again
    changes nothing and gets the same answer.

    A null text counts as empty. A null id loses against any other, and where
    all ids are null all rows stay; rows that share id and text share the
    answer. Other columns are not looked at; an empty table gives none.

    Texts are reduced to digests at once, and copies are combined before the
    shuffle. Digests meet the index in a sort-merge anti-join, one row a text.
    """
    spark = docs.sparkSession
    keyed = plain(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
    )
    keyed = stored(keyed, "digests")
    groups = keyed.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = stored(groups.withColumn("load", F.lit(load)), "groups")
    known = index.read().hint("merge")
    index.append(groups.join(known.select("digest"), "digest", "left_anti"))
    # One row a text on both sides; then the copies, whose skew adaptive execution splits.
    answer = groups.select("digest").join(index.read().hint("merge"), "digest")
    answer = stored(answer, "answers")
    kept = (F.col("load") == load) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return keyed.join(answer, "digest").select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents as the first load of a new index."""
    index = DigestIndex(spark, new_folder(spark, "digest-index"))
    result = add_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), index, "documents")
    index.close()
    return result


OP4_SQL = """
select doc_id,
       max(doc_id) over same as keep_id,
       count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
window same as (partition by coalesce(text, ''))
"""
