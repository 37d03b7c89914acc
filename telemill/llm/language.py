"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.words import map_batches, plain, starts_of

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
# The model is fitted on this many texts of a language at most, chosen by a hash of their id.
TEXTS_PER_LANGUAGE = 4000
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else 0."""
    points = np.arange(0x110000, dtype=np.uint32)
    kinds = np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
    return np.where(kinds, points, 0).astype(np.uint32)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts, the number of each text, and whether it has a letter.

    Texts are lower-cased; what is not a letter counts as a gap. N-grams lie
    within a text and begin with a letter or a gap before one.
    """
    parts = [
        np.frombuffer((" " + (t or "").lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        for t in texts.to_pylist()
    ]
    sizes = np.array([len(p) for p in parts], np.int64)
    points = _letters()[np.concatenate(parts)] if parts else np.zeros(0, np.uint32)
    text = np.repeat(np.arange(len(sizes)), sizes)
    letter = points > 0
    found, of = [], []
    key = np.zeros(len(points), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        count = max(len(points) - order + 1, 0)
        key = (key[:count] ^ points[order - 1 :]) * np.uint32(0x01000193) + np.uint32(order)
        if order not in ORDERS:
            continue
        at = letter[:count] if order == 1 else letter[:count] | letter[1 : count + 1]
        at = np.flatnonzero(at & (text[:count] == text[order - 1 :]))
        mixed = key[at] * np.uint32(0x9E3779B1)
        found.append((mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32))
        of.append(text[at])
    of_all = np.concatenate(of) if of else np.zeros(0, np.int64)
    order = np.argsort(of_all, kind="stable")
    counts = np.bincount(of_all, minlength=len(sizes))
    with_letter = np.bincount(text[letter], minlength=len(sizes)) > 0
    return (np.concatenate(found)[order] if found else np.zeros(0, np.int32)), counts, with_letter


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Counts of buckets by language, for the texts of a batch."""
    buckets, counts, _ = grams(batch["text"])
    names = batch["label"].dictionary_encode()
    codes = np.repeat(names.indices.to_numpy(), counts).astype(np.int64)
    total = np.bincount(codes * BUCKETS + buckets, minlength=0)
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays(
        [
            names.dictionary.take(pa.array(at // BUCKETS)),
            pa.array((at % BUCKETS).astype(np.int32)),
            pa.array(total[at]),
        ],
        names=["label", "bucket", "n"],
    )


def train(texts: DataFrame, prior: dict[str, int]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors and log probabilities (bucket by language) from ``text, label``.

    ``prior`` is the number of rows of each language, in the sample or not.
    What comes to the driver has a row for a bucket and language at most.
    """
    counted = map_batches(texts, _counted, "label string, bucket int, n bigint")
    rows = counted.groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(rows["label"].unique())
    table = np.ones((BUCKETS, len(names)))
    table[rows["bucket"], rows["label"].map({n: i for i, n in enumerate(names)})] += rows["n"]
    log_prior = np.log([prior[n] / sum(prior.values()) for n in names]) if names else np.zeros(0)
    return names, log_prior, np.log(table / table.sum(axis=0)).astype(np.float32)


def _scored(model):
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, log_prior, table = model.value
        buckets, counts, with_letter = grams(batch["text"])
        total = np.tile(log_prior, (len(counts), 1))
        some = counts > 0
        if some.any():
            # Sparse rows of the batch times the matrix, in slices that stay in the cache.
            for row, (start, count) in enumerate(zip(starts_of(counts), counts)):
                own = buckets[start : start + count]
                if count > BUCKETS:
                    total[row] += np.bincount(own, minlength=BUCKETS) @ table
                elif count:
                    total[row] += table[own].sum(axis=0, dtype=np.float64)
        known = with_letter & (len(names) > 0)
        best = total.argmax(axis=1) if len(names) else np.zeros(len(counts), int)
        odds = np.exp(total - total.max(axis=1, keepdims=True)) if len(names) else np.ones((len(counts), 1))
        score = np.where(known, 1 / odds.sum(axis=1), 0.0)
        label = [names[b] if k else UNKNOWN for b, k in zip(best, known)]
        return pa.RecordBatch.from_arrays(
            [*[batch[n] for n in batch.schema.names if n != "text"], pa.array(label, pa.string()), pa.array(score)],
            names=[*[n for n in batch.schema.names if n != "text"], "lang_pred", "score"],
        )

    return make


def remainder(id_col: str, divisor: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor


def identify(docs: DataFrame, learn: Column, id_col="doc_id", text_col="text", label_col="lang") -> DataFrame:
    """Language of each text: ``doc_id, lang_pred, score``, a row for each row.

    The n-grams are learned from at most ``TEXTS_PER_LANGUAGE`` whole texts a
    language, the priors from the number of all texts, of rows for which ``learn`` holds (over columns ``doc_id``,
    ``label``) and that have text and label; the language of a row is no input
    of its prediction. A text that is null or has no letter is ``und`` with
    score 0, as is every text if there is nothing to learn from. Rows may
    repeat and ids be null; other columns are not looked at.
    """
    docs = plain(docs, doc_id=id_col, text=text_col, label=label_col)
    usable = docs.where(learn & F.col("label").isNotNull() & F.col("text").isNotNull())
    # The ids of the sample are chosen before any text is moved.
    ids = usable.select("label", "doc_id", F.xxhash64("doc_id").alias("_order"))
    prior = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count("*").alias("n")).collect()}
    sample = None
    for label in prior:
        part = ids.where(F.col("label") == label).orderBy("_order", "doc_id").limit(TEXTS_PER_LANGUAGE)
        sample = part if sample is None else sample.union(part)
    spark = docs.sparkSession
    if sample is None:
        model = ([], np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    else:
        chosen = sample.select("doc_id").distinct()
        model = train(usable.join(chosen, "doc_id", "left_semi").select("text", "label"), prior)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), _scored(shared), f"doc_id {kind}, lang_pred string, score double")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those whose remainder modulo 5 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    learn = F.coalesce(remainder("doc_id", 5) != 0, F.lit(False))
    return identify(docs, learn).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
