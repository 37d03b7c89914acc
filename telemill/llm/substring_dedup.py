"""Removal of long passages that occur more than once, found by recompression.

Rounds name runs and pairs of tokens by a hash of their parts, so that equal
token sequences get equal symbols wherever they stand, in every task and
without a dictionary: only symbols at the rim of a passage depend on what is
around it. Long symbols that occur once rule out all windows around them; the
windows that are left are named whole and counted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.words import Words, lists, map_batches, mix, plain, signed, starts_of
from telemill.session import stored

ROUNDS = 6
# Symbols stand for this many words at most, so that several fit into a window.
LONGEST = 16


def _windows(counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window, and the number of windows of each text."""
    per_text = np.maximum(counts - window + 1, 0)
    first = np.repeat(starts_of(counts) - starts_of(per_text), per_text) + np.arange(per_text.sum())
    return first, per_text


class Parse:
    """Symbols of a batch of texts after all rounds, and those that each window determines.

    ``low`` and ``high`` are the first and last symbol that follow from the
    words of a window alone; windows with ``low > high`` determine none.
    """

    def __init__(self, names: np.ndarray, counts: np.ndarray, window: int):
        text = np.repeat(np.arange(len(counts)), counts)
        length = np.ones(len(names), np.int64)
        self.first, self.per_text = _windows(counts, window)
        low, high = self.first, self.first + (window - 1)

        # Runs. The first and the last run of a window may go on outside it.
        new = np.ones(len(names), bool)
        new[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
        run = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(names)))
        if len(names):
            low = begin[np.minimum(run[low] + 1, len(begin) - 1)] + np.where(
                run[low] + 1 < len(begin), 0, len(names)
            )
            high = begin[run[high]] - 1
        merged = (size > 1) & (size <= LONGEST)
        keep = new | ~merged[run]
        names = np.where(merged[run], mix(names ^ mix(size[run].astype(np.uint64))), names)[keep]
        length, text = np.where(merged[run], size[run], 1)[keep], text[keep]
        low, high = _moved(low, high, keep)

        # Pairs: left and right symbols are told apart by a bit of their name.
        for turn in range(ROUNDS):
            right = (mix(names, turn) >> np.uint64(63)).astype(bool)
            pair = np.zeros(len(names), bool)
            if len(names) > 1:
                pair[:-1] = (
                    ~right[:-1]
                    & right[1:]
                    & (text[1:] == text[:-1])
                    & (length[1:] + length[:-1] <= LONGEST)
                )
            if len(names):
                # A right symbol may join what is before the window, a left one what is behind it.
                some = low <= high
                low = low + (right[np.minimum(low, len(names) - 1)] & some)
                high = high - (~right[np.maximum(np.minimum(high, len(names) - 1), 0)] & some)
            keep = np.ones(len(names), bool)
            keep[1:] = ~pair[:-1]
            at = np.flatnonzero(pair)
            names, length = names.copy(), length.copy()
            names[at] = mix(mix(names[at]) + np.uint64(3) * names[at + 1])
            length[at] += length[at + 1]
            names, length, text = names[keep], length[keep], text[keep]
            low, high = _moved(low, high, keep)
        # Longer symbols count as larger: they are rarer.
        self.keys = (length.astype(np.uint64) << np.uint64(58)) | (names >> np.uint64(6))
        self.text, self.low, self.high = text, low, high

    def anchors(self) -> np.ndarray:
        """The largest symbol that each window determines, by position; -1 if it determines none."""
        keys, best = self.keys, np.arange(len(self.keys))
        out = np.full(len(self.first), -1)
        span = self.high - self.low + 1
        width = 1
        while (span >= width).any():
            now = (span >= width) & (span < 2 * width)
            one, two = best[self.low[now]], best[self.high[now] - width + 1]
            out[now] = np.where(keys[two] > keys[one], two, one)
            ahead = best[np.minimum(np.arange(len(best)) + width, len(best) - 1)]
            best = np.where(keys[ahead] > keys[best], ahead, best)
            width *= 2
        return out


def _moved(low: np.ndarray, high: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window ends as positions among the kept symbols."""
    place = np.append(np.cumsum(keep) - 1, keep.sum())
    some = low <= high
    limit = len(keep)
    return (
        np.where(some, place[np.minimum(low, limit)], 1),
        np.where(some, place[np.clip(high, 0, limit)], 0),
    )


def _window_hashes(words: np.ndarray, first: np.ndarray, window: int, seed: int) -> np.ndarray:
    value = np.zeros(len(first), np.uint64)
    single = mix(words, seed)
    for step in range(window):
        value = value * np.uint64(0xD1342543DE82EF95) + single[first + step]
    return mix(value)


def _joined(words: Words, mask: np.ndarray | None = None) -> list[bytes]:
    """Each text's words (those of the mask), joined by one space."""
    out = []
    ends = np.cumsum(words.counts)
    for start, end in zip(ends - words.counts, ends):
        begin, stop = words.begin[start:end], words.end[start:end]
        if mask is not None:
            begin, stop = begin[mask[start:end]], stop[mask[start:end]]
        if not len(begin):
            out.append(b"")
            continue
        # Consecutive words that one space parts are taken in one piece.
        cut = np.flatnonzero((begin[1:] != stop[:-1] + 1) | (words.data[stop[:-1]] != 0x20)) + 1
        pieces = zip(begin[np.append(0, cut)], stop[np.append(cut - 1, len(stop) - 1)])
        out.append(b" ".join(words.slice(a, b) for a, b in pieces))
    return out


def _digest(texts: list[bytes]) -> list[str]:
    return [hashlib.sha256(text).hexdigest() for text in texts]


def _parsed(window: int):
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch["text"])
        parse = Parse(words.hashes, words.counts, window)
        found = parse.anchors()
        none = np.bincount(
            np.repeat(np.arange(len(words.counts)), parse.per_text)[found < 0],
            minlength=len(words.counts),
        )
        used = np.unique(found[found >= 0])
        per_text = np.bincount(parse.text[used], minlength=len(words.counts))
        return pa.RecordBatch.from_arrays(
            [
                *[batch[name] for name in ("doc_id", "k1", "k2")],
                pa.array(words.counts.astype(np.int64)),
                pa.array(_digest(_joined(words))),
                pa.array(none > 0),
                lists(signed(parse.keys[used]), per_text, pa.int64()),
            ],
            names=["doc_id", "k1", "k2", "n_words", "digest", "open", "anchors"],
        )

    return make


def _candidates(window: int):
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch["text"])
        parse = Parse(words.hashes, words.counts, window)
        found = parse.anchors()
        of = np.repeat(np.arange(len(words.counts)), parse.per_text)
        # An anchor counts as repeated only in the texts that were told so.
        repeated = batch["repeated"]
        sizes = np.diff(repeated.offsets.to_numpy())
        flat = repeated.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        told = np.unique(mix(flat) + np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes))
        own = mix(parse.keys[found]) + of.astype(np.uint64) if len(found) else mix(parse.keys[:0])
        chosen = (found < 0) | np.isin(own, told)
        first, of = parse.first[chosen], of[chosen]
        place = first - starts_of(words.counts)[of]
        second = _window_hashes(words.others, first, window, 1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(signed(_window_hashes(words.hashes, first, window, 0))),
                pa.array(signed(second)),
                pa.array(place.astype(np.int32)),
                batch["k1"].take(pa.array(of)),
                batch["k2"].take(pa.array(of)),
            ],
            names=["w1", "w2", "place", "k1", "k2"],
        )

    return make


def _without(window: int, with_text: bool = False):
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch["text"])
        places = batch["places"]
        sizes = np.diff(places.offsets.to_numpy())
        first = places.flatten().to_numpy(zero_copy_only=False) + np.repeat(starts_of(words.counts), sizes)
        change = np.zeros(len(words.hashes) + 1, np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, first + window, -1)
        kept = np.cumsum(change)[:-1] == 0
        removed = np.add.reduceat(np.append(~kept, False), starts_of(words.counts), dtype=np.int64)
        removed = np.where(words.counts > 0, removed, 0)
        return pa.RecordBatch.from_arrays(
            [
                batch["k1"],
                batch["k2"],
                pa.array(removed),
                pa.array(_joined(words, kept)).cast(pa.string()) if with_text else pa.array(_digest(_joined(words, kept))),
            ],
            names=["k1", "k2", "removed", "rest"],
        )

    return make


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, with_text: bool = False
) -> DataFrame:
    """What is left of each text without repeated passages: ``doc_id, n_words, n_removed, kept_sha256``.

    A word goes if a window of ``window`` words that covers it has the same
    words as a window that starts anywhere else, in the same or another text.
    One row for each row; equal texts are worked on once, and all their words
    go if they have a window. Null, empty and short texts lose nothing, and
    ids may be null or repeated, since texts are told apart by their content.
    Other columns are not looked at. An empty table gives an empty result.

    With ``with_text``, ``kept_text`` has the words that stay, joined by one
    space, and ``kept_sha256`` is taken from it.

    Joins are on the content of a text, a symbol or a window: very frequent
    ones are combined before the shuffle of their counts, and split by adaptive
    execution in the joins that carry them back.
    """
    docs = (
        plain(docs, doc_id=id_col, text=text_col)
        .withColumn("text", F.coalesce("text", F.lit("")))
        .withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), "text")})
    )
    identity = docs.schema["doc_id"].dataType.simpleString()
    parsed = stored(
        map_batches(
            docs,
            _parsed(window),
            f"doc_id {identity}, k1 bigint, k2 bigint, n_words bigint, digest string, "
            "open boolean, anchors array<bigint>",
        ),
        "parsed",
    )
    copies = parsed.groupBy("k1", "k2").agg(F.count("*").alias("copies"))
    texts = parsed.where(f"n_words >= {window}")
    anchors = (
        texts.groupBy("k1", "k2")
        .agg(F.first("anchors").alias("anchors"))
        .select("k1", "k2", F.explode("anchors").alias("anchor"))
    )
    often = anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    told = (
        anchors.join(often, "anchor")
        .groupBy("k1", "k2")
        .agg(F.collect_set("anchor").alias("repeated"))
    )
    told = told.unionByName(
        texts.where("open").select("k1", "k2", F.array().cast("array<bigint>").alias("repeated"))
    )
    told = told.groupBy("k1", "k2").agg(F.flatten(F.collect_list("repeated")).alias("repeated"))
    # One copy of each text that may hold a repeated window.
    suspects = stored(
        docs.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(told, ["k1", "k2"]),
        "suspects",
    )
    windows = map_batches(
        suspects, _candidates(window), "w1 bigint, w2 bigint, place int, k1 bigint, k2 bigint"
    )
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    places = (
        windows.join(twice, ["w1", "w2"])
        .groupBy("k1", "k2")
        .agg(F.collect_list("place").alias("places"))
    )
    parts = suspects.select("k1", "k2", "text").join(places, ["k1", "k2"])
    if with_text:
        once = docs.groupBy("k1", "k2").agg(F.first("text").alias("text"))
        parts = once.join(places, ["k1", "k2"], "left").withColumn(
            "places", F.coalesce("places", F.array().cast("array<int>"))
        )
    less = map_batches(
        parts,
        _without(window, with_text),
        "k1 bigint, k2 bigint, removed bigint, rest string",
    )
    result = copies.join(less, ["k1", "k2"], "left")
    whole = (F.col("copies") > 1) & (F.col("n_words") >= window)
    removed = F.when(whole, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed")
    if with_text:
        text = F.when(whole, F.lit("")).otherwise(F.col("rest"))
        return parsed.join(result, ["k1", "k2"]).select(
            "doc_id", "n_words", removed, F.sha2(text, 256).alias("kept_sha256"), text.alias("kept_text")
        )
    return parsed.join(result, ["k1", "k2"]).select(
        "doc_id",
        "n_words",
        removed,
        F.when(whole, F.sha2(F.lit(""), 256))
        .otherwise(F.coalesce("rest", "digest"))
        .alias("kept_sha256"),
    )


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without passages of 35 or more words that occur more than once."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH rows_ AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), windows AS (
    SELECT r, p, md5(array_to_string(words[p:p + 34], ' ')) AS name
    FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS p FROM rows_ WHERE len(words) >= 35)
), covered AS (
    SELECT DISTINCT r, unnest(range(p, p + 35)) AS place
    FROM windows WHERE name IN (SELECT name FROM windows GROUP BY name HAVING count(*) > 1)
), placed AS (
    SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM rows_
), left_over AS (
    SELECT r, string_agg(word, ' ' ORDER BY place) AS rest FROM placed ANTI JOIN covered USING (r, place) GROUP BY r
), removed AS (
    SELECT r, count(*) AS n FROM covered GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
    sha256(coalesce(rest, '')) AS kept_sha256
FROM rows_ LEFT JOIN left_over USING (r) LEFT JOIN removed USING (r)
"""
