"""Ranked lexical search, reversed: documents stream past an inverted index over the items' terms.

There are few items and many documents, so the index is made of the items. A
first pass counts each document's terms and keeps the counts of those that some
item has; the counts give the weights of the terms. A second pass takes the
counts of the documents through the index, and each task keeps a bounded heap
of best documents for each item. The heaps are merged in two steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemill.llm.words import plain, slices, starts_of, utf8
from telemill.session import stored

BEST = 10
SLICE_BYTES = 1 << 21
# Items are taken in blocks whose texts have at most this many bytes together, a single longer
# one apart: what is broadcast at once is bounded, however many items there are.
BLOCK_BYTES = 8 << 20
# Scores of a document and an item, and shares in them, that a task holds at once.
CELLS = 1 << 21
HEAPS = 256  # groups of tasks whose heaps meet in the first merge

_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_IN_TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms of all texts in order, A-Z in lower case, and how many each text has (null: 0).

    A term is a longest run of letters and digits of ASCII and of all other
    characters beyond ASCII.
    """
    data, offsets = utf8(texts)
    inside = _IN_TERM[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    begin = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(begin, offsets))
    # Without the bytes between terms, a term ends where the next begins.
    kept = np.concatenate(([0], np.cumsum(inside)))
    borders = np.append(kept[begin], kept[-1])
    buffers = [None, pa.py_buffer(borders.astype(np.int64)), pa.py_buffer(_LOWER[data[inside]])]
    return pa.Array.from_buffers(pa.large_binary(), len(begin), buffers), counts


class ItemIndex:
    """Distinct terms of a block of items, and for each term the items that have it."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.items = [number for number, _ in items]
        found, counts = terms(pa.array([text for _, text in items], pa.string()))
        owner = np.repeat(np.arange(len(items)), counts)
        coded = found.dictionary_encode()
        self.terms = coded.dictionary
        pairs = np.unique(coded.indices.to_numpy().astype(np.int64) * max(len(items), 1) + owner)
        term, self.owners = np.divmod(pairs, max(len(items), 1))
        self.counts = np.bincount(term, minlength=len(self.terms))
        self.starts = starts_of(self.counts)


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """Numbered items, a block at a time, through the driver."""
    block, size = [], 0
    for row in items.toLocalIterator(prefetchPartitions=False):
        length = len((row["text"] or "").encode())
        if block and size + length > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row["number"], row["text"]))
        size += length
    if block:
        yield block


def term_counts(docs: DataFrame, shared) -> DataFrame:
    """``doc_id, n, term, tf`` of each document: all its terms with repeats, and the counts of the items' terms."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared.value
        size = max(len(index.terms), 1)
        for batch in slices(batches, SLICE_BYTES):
            found, counts = terms(batch["text"])
            # Equal terms of a slice are looked up once.
            coded = found.dictionary_encode()
            place = pc.fill_null(pc.index_in(coded.dictionary, value_set=index.terms), -1).to_numpy()
            term = place[coded.indices.to_numpy()] if len(place) else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(batch.num_rows), counts)
            hit = term >= 0
            pairs, tf = np.unique(owner[hit] * size + term[hit], return_counts=True)
            owner, term = np.divmod(pairs, size)
            offsets = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(counts.astype(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int64))),
                ],
                names=["doc_id", "n", "term", "tf"],
            )

    return docs.mapInArrow(run, f"doc_id {kind}, n bigint, term array<int>, tf array<bigint>")


def weights(counted: DataFrame, terms_of_items: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the weight of each of the items' terms."""
    total = counted.where("n > 0").agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
    frequency = counted.select(F.explode("term").alias("term")).groupBy("term").count().collect()
    documents = np.zeros(terms_of_items, np.int64)
    for row in frequency:  # a row for each term of the index at most
        documents[row["term"]] = row["count"]
    n = total["N"]
    weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for df in documents.tolist()]
    return n, total["L"] or 0, np.array(weight, np.int64)


def discounts(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """8 * m of each document; products are taken without a bound, then cut down."""
    distinct, which = np.unique(n, return_inverse=True)
    # Beyond 2**59 the discount leaves no term a share, so it may stop there.
    values = [8 * (10 + min(90 * x * documents // length, 1 << 56)) if length else 80 for x in distinct.tolist()]
    return np.array(values, np.int64)[which]


class Heaps:
    """The best documents of each item: by score, then the smaller id, a missing id last."""

    def __init__(self, items: int, best: int):
        self.best = best
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.missing = np.zeros(0, bool)
        self.least = np.zeros(items, np.int64)  # below or equal: no place left for a later document

    def push(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, missing: np.ndarray) -> None:
        item, score = np.append(self.item, item), np.append(self.score, score)
        doc, missing = np.append(self.doc, doc), np.append(self.missing, missing)
        order = np.lexsort((doc, missing, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[place < self.best]
        self.item, self.score = item[place < self.best], score[order]
        self.doc, self.missing = doc[order], missing[order]
        full = np.bincount(self.item, minlength=len(self.least)) == self.best
        last = np.searchsorted(self.item, np.flatnonzero(full), side="right") - 1
        self.least[full] = self.score[last] - 1  # equal scores may still have a smaller id


def heaps(counted: DataFrame, shared, best: int, documents: int, length: int, weight) -> DataFrame:
    """``number, doc_id, score``: the heap of each item in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared.value
        items, gain = len(index.items), weight.value  # a block has one item at least
        kept = Heaps(items, best)
        for batch in batches:
            per_doc = pc.list_value_length(batch["term"]).to_numpy(zero_copy_only=False)
            term, tf = (batch[c].flatten().to_numpy() for c in ("term", "tf"))
            owner = np.repeat(np.arange(batch.num_rows), per_doc)
            below = discounts(batch["n"].to_numpy(), documents, length)[owner]
            share = gain[term] * (1_000_000_000 * tf // (1000 * tf + below))
            missing = batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
            doc_id = pc.fill_null(batch["doc_id"], 0).to_numpy()
            links = index.counts[term]
            hits = np.concatenate(([0], np.cumsum(per_doc)))
            sums = np.concatenate(([0], np.cumsum(links)))[hits]
            start = 0
            while start < batch.num_rows:
                stop = min(start + max(1, CELLS // items), int(np.searchsorted(sums, sums[start] + CELLS, "right")) - 1)
                stop = max(stop, start + 1)
                a, b = hits[start], hits[stop]
                # A term of a document gives its share to all items that have it.
                at = np.repeat(index.starts[term[a:b]] - starts_of(links[a:b]), links[a:b])
                at = index.owners[at + np.arange(len(at))]
                scores = np.zeros((stop - start) * items, np.int64)
                np.add.at(scores, np.repeat((owner[a:b] - start) * items, links[a:b]) + at, np.repeat(share[a:b], links[a:b]))
                scores = scores.reshape(stop - start, items)
                doc, item = np.nonzero(scores > kept.least)
                if len(doc):
                    kept.push(item, scores[doc, item], doc_id[start + doc], missing[start + doc])
                start = stop
        if len(kept.item):
            numbers = np.array(index.items, np.int64)[kept.item]
            columns = [pa.array(numbers), pa.array(kept.doc, mask=kept.missing), pa.array(kept.score)]
            yield pa.RecordBatch.from_arrays(columns, names=["number", "doc_id", "score"])

    return counted.mapInArrow(run, "number bigint, doc_id bigint, score bigint")


def ranked(found: DataFrame, best: int) -> DataFrame:
    """The best of all heaps; those of a group of tasks meet first, so that no task reads all heaps of an item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    first = Window.partitionBy("number", "part").orderBy(*order)
    found = found.withColumn("part", F.spark_partition_id() % HEAPS)
    found = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= best)
    last = Window.partitionBy("number").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= best).drop("part")


def search(
    docs: DataFrame,
    items: DataFrame,
    best: int = BEST,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``best`` documents with a score for each item.

    Every row of both tables counts: equal texts are as many documents, and an
    item whose id is null or repeated is ranked for each of its rows. Null and
    empty texts have no terms; such an item has no rows, such a document is not
    counted. A document whose id is null ranks behind equal scores with an id.
    Ids of documents are numbers. Empty tables give an empty result; other
    columns are not looked at. The counts of the documents' terms, for the
    items' terms alone, are written to the shared folder.
    """
    spark: SparkSession = docs.sparkSession
    docs = plain(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    # Written once, so that a number stays with its item.
    numbered = stored(
        plain(items, item_id=item_col, text=item_text_col).withColumn("number", F.monotonically_increasing_id()),
        "items",
    )
    out = spark.createDataFrame([], "number bigint, doc_id bigint, score bigint, rank int")
    for block in item_blocks(numbered):
        index = ItemIndex(block)
        shared = spark.sparkContext.broadcast(index)
        counted = stored(term_counts(docs, shared), "term-counts")
        documents, length, weight = weights(counted, len(index.terms))
        given = spark.sparkContext.broadcast(weight)
        out = out.unionByName(ranked(heaps(counted, shared, best, documents, length, given), best))
    return out.join(numbered.select("number", "item_id"), "number").select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"
    )


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH doc_terms AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), tf AS (
    SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY ALL
), lengths AS (
    SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id
), totals AS (
    SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM lengths
), weight AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM tf, totals GROUP BY term, docs
), item_terms AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), scores AS (
    SELECT item_id, doc_id,
        sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length))))::BIGINT AS score
    FROM item_terms JOIN tf USING (term) JOIN weight USING (term) JOIN lengths USING (doc_id), totals
    GROUP BY item_id, doc_id
), placed AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
    FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""
