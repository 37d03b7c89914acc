"""Near-duplicate documents by circulant MinHash, with every link confirmed on full sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.components import connected
from telemill.llm.words import Words, lists, map_batches, mix, plain, signed, starts_of
from telemill.session import stored

# A pair at similarity 0.8 shares no band with a chance of (1 - 0.8**4)**28 = 4e-7.
BANDS, ROWS = 28, 4
# What the stars leave is compared in blocks of buckets, by bitmaps of this many bits.
BITS, BLOCK = 8192, 1024


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word shingles of each text by two independent hashes, sorted by the first, and their number in each.

    A-Z count as a-z. A text of fewer words is one shingle, a text without
    words has none.
    """
    words = Words(texts, lower=True)
    counts = np.where(words.counts >= size, words.counts - size + 1, np.minimum(words.counts, 1))
    width = np.repeat(np.minimum(words.counts, size), counts)
    first = np.repeat(starts_of(words.counts) - starts_of(counts), counts) + np.arange(counts.sum())
    value, other = width.astype(np.uint64), width.astype(np.uint64)
    for step in range(size):
        more = width > step
        value[more] = mix(value[more] ^ words.hashes[first[more] + step])
        other[more] = mix(other[more] ^ words.others[first[more] + step])
    ends = np.cumsum(counts)
    places = [start + np.unique(value[start:end], return_index=True)[1] for start, end in zip(ends - counts, ends)]
    counts = np.array([len(part) for part in places], np.int64)
    chosen = np.concatenate(places) if places else np.zeros(0, np.int64)
    return value[chosen], counts, other[chosen]


def _permuted(places: np.ndarray) -> np.ndarray:
    """The second permutation of 0 .. 2**32-1 (the finaliser of a 32-bit murmur hash)."""
    places ^= places >> np.uint32(16)
    places *= np.uint32(0x85EBCA6B)
    places ^= places >> np.uint32(13)
    places *= np.uint32(0xC2B2AE35)
    places ^= places >> np.uint32(16)
    return places


def signatures(values: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Circulant MinHash of non-empty sets: one row of ``length`` coordinates for each.

    The first permutation scatters the elements over 2**32 places. Coordinate k
    is the smallest value of the second permutation, shifted circularly by k,
    over the places of a set.
    """
    places = (mix(values, 1) >> np.uint64(32)).astype(np.uint32)
    starts = starts_of(counts)
    out = np.empty((len(counts), length), np.uint32)
    for k in range(length if len(counts) else 0):
        out[:, k] = np.minimum.reduceat(_permuted(places + np.uint32(k)), starts)
    return out


def _band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for row in range(rows):
        key = mix(key ^ parts[:, :, row])
    return key


def _sets_of(size: int, bands: int, rows: int):
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, counts, others = shingles(batch["text"], size)
        full = counts > 0
        keys = np.zeros((2, len(counts)), np.uint64)
        for place, some in enumerate((values, others)):  # a sum does not depend on the order
            keys[place, full] = np.add.reduceat(mix(some, 2), starts_of(counts)[full]) if full.any() else 0
        band = _band_keys(signatures(values, counts[full], bands * rows), bands, rows)
        return pa.RecordBatch.from_arrays(
            [
                batch["doc_id"],
                pa.array(counts),
                pa.array(signed(keys[0])),
                pa.array(signed(keys[1])),
                lists(signed(band.ravel()), full * bands, pa.int64()),
            ],
            names=["doc_id", "n_shingles", "k1", "k2", "bands"],
        )

    return make


def _similar(size: int, percent: int):
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, left_counts, left_others = shingles(batch["text"], size)
        right, right_counts, right_others = shingles(batch["other"], size)
        keep = []
        parts = zip(
            *[np.split(some, starts_of(left_counts)[1:]) for some in (left, left_others)],
            *[np.split(some, starts_of(right_counts)[1:]) for some in (right, right_others)],
        )
        for one, one_other, two, two_other in parts:
            # A shingle is common only if both of its hashes are.
            _, mine, its = np.intersect1d(one, two, assume_unique=True, return_indices=True)
            common = int((one_other[mine] == two_other[its]).sum())
            union = len(one) + len(two) - common
            keep.append(common > 0 and 100 * common >= percent * union)
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return make


def _confirmed(texts: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar."""
    pairs = stored(pairs.distinct(), "pairs")
    left = texts.select(F.col("doc_id").alias("a"), "text")
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("other"))
    both = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b")
    found = map_batches(both, _similar(size, percent), "a bigint, b bigint")
    return stored(found.distinct(), "links")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """Groups of near-duplicate documents: ``doc_id, n_shingles, component_id, kept``, a row for each row.

    Two documents are linked if 100 * |intersection| >= ``percent`` * |union|
    of their shingle sets. Equal sets are one class from the start, so copies
    never meet as pairs. Classes that share a band are candidates: all members
    of a bucket are compared with its smallest. Buckets that then still hold
    several components are cut into blocks, where every member meets every
    other one as a bitmap of its set. A bitmap bounds the intersection from
    above, so it rules out no similar pair; pairs of different components that
    it lets pass are compared by their full sets.

    Empty and null texts, and rows without an id, are linked with nothing; a
    row without an id has no component and is kept. Rows that share an id count
    as one document with all their texts. Other columns are not looked at. An
    empty table gives an empty result.
    """
    docs = plain(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    schema = "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>"
    sets = stored(map_batches(docs, _sets_of(shingle, bands, rows), schema), "sets")
    full = sets.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    # Members of a class have equal bands; those of its smallest document stand for it.
    member = (
        full.groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        .select("rep", "n", F.explode("bands").alias("bucket"))
    )
    member = stored(member, "buckets")
    shared = (
        member.groupBy("bucket")
        .agg(F.min("rep").alias("least"), F.count("*").alias("members"))
        .where("members > 1")
    )
    member = stored(member.join(shared, "bucket"), "buckets")

    fits = f"100 * least(n, n_other) >= {percent} * greatest(n, n_other)"
    sizes = member.select(F.col("rep").alias("other"), F.col("n").alias("n_other")).distinct()

    stars = member.where("rep <> least").select(F.col("least").alias("other"), "rep", "n").distinct()
    stars = stars.join(sizes, "other").where(fits).select(F.col("other").alias("a"), F.col("rep").alias("b"))

    # The only time that all texts are moved: after it, those of the members are at hand.
    reps = member.select("rep").distinct().hint("merge")
    texts = docs.join(reps, docs["doc_id"] == reps["rep"], "left_semi")
    texts = stored(texts, "texts")
    links = _confirmed(texts, stars, shingle, percent)
    groups = stored(connected(links), "components")
    contested = _contested(member, groups)
    new = _confirmed(texts, _across(texts, contested, shingle, percent), shingle, percent)
    if not new.isEmpty():
        groups = stored(connected(links.union(new)), "components")

    named = classes.join(groups, F.col("rep") == F.col("node"), "left").select(
        "k1", "k2", F.coalesce("component", "rep").alias("component")
    )
    known = sets.where("n_shingles > 0").join(named, ["k1", "k2"], "left")
    rest = sets.where("n_shingles = 0").withColumn("component", F.lit(None).cast("bigint"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return (
        known.select("doc_id", "n_shingles", "component")
        .union(rest.select("doc_id", "n_shingles", "component"))
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _contested(member: DataFrame, groups: DataFrame) -> DataFrame:
    """Members, with their components, of the buckets that hold more than one component."""
    labelled = member.join(groups, F.col("rep") == F.col("node"), "left").select(
        "bucket", "rep", "n", "members", F.coalesce("component", "rep").alias("component")
    )
    mixed = (
        labelled.groupBy("bucket")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low < high")
        .select("bucket")
    )
    return stored(labelled.join(mixed, "bucket"), "contested")


def _bitmaps(size: int):
    """A bit for each shingle of a set, and the shingles less the bits."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, counts, _ = shingles(batch["text"], size)
        places = (mix(values, 5) % np.uint64(BITS)).astype(np.int64)
        bits = np.zeros((len(counts), BITS), bool)
        bits[np.repeat(np.arange(len(counts)), counts), places] = True
        packed = np.packbits(bits, axis=1)
        return pa.RecordBatch.from_arrays(
            [
                batch["rep"],
                pa.array([row.tobytes() for row in packed], pa.binary()),
                pa.array(counts - bits.sum(axis=1)),
            ],
            names=["rep", "bits", "hidden"],
        )

    return make


def _close(percent: int):
    """Pairs of one part of a bucket, or of two, that may be similar and share no smaller bucket.

    The intersection is at most the number of common bits, and the smaller of
    the numbers of shingles that have no bit of their own.
    """

    def make(block: pa.Table) -> pa.Table:
        rep, size, hidden, component, part = (
            block[name].to_numpy() for name in ("rep", "n", "hidden", "component", "part")
        )
        bits = np.frombuffer(b"".join(block["bits"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
        buckets = [set(b) for b in block["buckets"].to_pylist()]
        bucket = block["bucket"][0].as_py()
        two = part.min() < part.max()
        pairs = []
        for i in range(len(rep)):
            other = np.flatnonzero((part > part[i]) if two else (rep > rep[i]))
            fits = 100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i])
            other = other[fits & (component[other] != component[i])]
            common = np.bitwise_count(bits[other] & bits[i]).sum(axis=1, dtype=np.int64)
            common += np.minimum(hidden[other], hidden[i])
            for j in other[100 * common >= percent * (size[other] + size[i] - common)]:
                if min(buckets[i] & buckets[j]) == bucket:
                    pairs.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
        a, b = zip(*pairs) if pairs else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return make


def _across(texts: DataFrame, member: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs of one bucket that lie in different components and may be similar.

    A large bucket is cut into parts of about ``BLOCK``; a task has one part or
    two of it, so none holds a whole large bucket, and only pairs that pass
    leave it.
    """
    reps = member.groupBy("rep").agg(F.collect_set("bucket").alias("buckets")).hint("merge")
    texts = texts.join(reps, texts["doc_id"] == reps["rep"], "left_semi").withColumnRenamed("doc_id", "rep")
    bitmaps = map_batches(texts, _bitmaps(size), "rep bigint, bits binary, hidden bigint")
    rows = (
        member.join(bitmaps.join(reps, "rep").hint("merge"), "rep")
        .withColumn("parts", F.ceil(F.col("members") / BLOCK).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumns({"low": F.least("part", "with"), "high": F.greatest("part", "with")})
        .select("bucket", "low", "high", "part", "rep", "n", "component", "buckets", "bits", "hidden")
    )
    return rows.groupBy("bucket", "low", "high").applyInArrow(_close(percent), "a bigint, b bigint")


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on 2-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)


OP1_SQL = r"""
WITH RECURSIVE rows_ AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS words
    FROM documents
), pairs_of_words AS (
    SELECT r, words, unnest(range(1, greatest(len(words), 2))) AS p FROM rows_ WHERE len(words) > 0
), shingles AS (
    SELECT DISTINCT r, CASE WHEN len(words) = 1 THEN words[1] ELSE words[p] || ' ' || words[p + 1] END AS shingle
    FROM pairs_of_words
), sizes AS (
    SELECT r, count(*) AS n FROM shingles GROUP BY r
), common AS (
    SELECT a.r AS a, b.r AS b, count(*) AS shared
    FROM shingles a JOIN sizes x ON a.r = x.r
    JOIN shingles b ON a.shingle = b.shingle AND a.r < b.r
    JOIN sizes y ON b.r = y.r AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
    GROUP BY a.r, b.r
), links AS (
    SELECT a, b FROM common JOIN sizes x ON a = x.r JOIN sizes y ON b = y.r
    WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), both_ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
    SELECT r AS a, r AS b FROM rows_
    UNION
    SELECT reached.a, both_ways.b FROM reached JOIN both_ways ON reached.b = both_ways.a
), smallest AS (
    SELECT reached.a AS r, min(doc_id) AS component_id FROM reached JOIN rows_ ON reached.b = rows_.r GROUP BY reached.a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM rows_ JOIN smallest USING (r) LEFT JOIN sizes USING (r)
"""
