"""The documents pipeline: each stage takes what the one before kept.

``STAGES`` lists (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns a table, which :func:`run` writes as Parquet and reads again for the
next stage. SQL cannot express the classifier of the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from telemill.llm import stages
from telemill.session import freed_folders, new_folder

STAGES = [
    ("toxicity", stages.without_toxic),
    ("exact_dedup", stages.without_copies),
    ("near_dedup", stages.without_near_copies),
    ("secret_scan", stages.without_secrets),
    ("packing", stages.packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. What a stage keeps on disk goes when its rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = new_folder(spark, name)
        with freed_folders():
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(folder)
        docs = spark.read.schema(kept.schema).parquet(folder)
    return docs
