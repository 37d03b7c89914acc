"""The stages of the documents pipeline: (spark, docs, sf_dir) to the rows that stay, or to batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm.exact_dedup import DigestIndex, add_documents
from telemill.llm.near_dedup import near_duplicates
from telemill.llm.packing import pack
from telemill.llm.secrets import redact
from telemill.llm.toxicity import not_held_out, score_toxicity
from telemill.session import new_folder, stored


#: Rows of a list of decisions up to which it goes to the documents; beyond, both are shuffled.
LISTED = 1_000_000


def _listed(decisions: DataFrame, label: str) -> DataFrame:
    """Decisions written down and counted: small ones are broadcast, so that no text moves for them."""
    decisions = stored(decisions, label)
    return F.broadcast(decisions) if decisions.count() <= LISTED else decisions.hint("merge")


def _keys(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes of the text of a row; null counts as empty."""
    text = F.coalesce(docs["text"], F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject; a text is rejected wherever it stands.

    Null and empty texts have a score like any other, null ids are never
    learned from, and rows that repeat stay or go together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = score_toxicity(docs, labels, not_held_out())
    rejected = _listed(scores.where("predicted = 1").select("k1", "k2").distinct(), "rejected")
    k1, k2 = _keys(docs)
    return docs.join(rejected, (k1 == rejected["k1"]) & (k2 == rejected["k2"]), "left_anti")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, of the largest id; null counts as empty, and a null id loses against any other.

    Of rows that share id and text, whichever comes first stays.
    """
    index = DigestIndex(spark, new_folder(spark, "digest-index"))
    decided = stored(add_documents(docs, index, "documents"), "decided")
    index.close()
    digest = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)

    def same(of: DataFrame) -> Column:
        return docs["doc_id"].eqNullSafe(of["_id"]) & (digest == of["text_sha256"])

    keys = [F.col("doc_id").alias("_id"), "text_sha256"]
    dropped = _listed(decided.where("not kept").select(*keys).distinct(), "dropped")
    kept = docs.join(dropped, same(dropped), "left_anti")
    several = stored(decided.where("kept").groupBy(*keys).count().where("count > 1"), "several")
    if several.isEmpty():
        return kept
    # A row that stays is there several times; only these rows are moved to choose one.
    several = _listed(several.select("_id", "text_sha256"), "several")
    once = kept.join(several, same(several), "left_anti")
    first = kept.join(several, same(several), "left_semi").withColumn("_digest", digest)
    return once.unionByName(first.dropDuplicates(["doc_id", "_digest"]).drop("_digest"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates on 5-word shingles, the one with the smallest id.

    Null, empty and single texts stay, as do rows without an id. Where texts
    share an id, each is a document of its own, and the smallest key of id and
    text stays.
    """
    ids = docs.where("doc_id is not null")
    shared = not ids.groupBy("doc_id").count().where("count > 1").isEmpty()
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit(""))) if shared else F.col("doc_id").cast("bigint")
    own = F.when(F.col("doc_id").isNotNull(), key)
    groups = near_duplicates(docs.select(own.alias("doc_id"), "text"), shingle=5, percent=80)
    dropped = _listed(groups.where("not kept").select(F.col("doc_id").alias("_id")).distinct(), "dropped")
    return docs.join(dropped, own == dropped["_id"], "left_anti")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by marks and ``n_chars``, if there is one, of the new text.

    A null text stays null; ids are not looked at, and rows may repeat.
    """
    clean = redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of the documents; null and empty texts, and rows that repeat, are packed like any other."""
    return pack(docs)
