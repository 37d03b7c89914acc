"""Words of whole texts as flat numpy arrays, for Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

# Texts of a batch are worked on in slices of about this many bytes.
SLICE_BYTES = 1 << 19


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts have about ``size`` bytes; one longer text is a slice."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            limit = (ends[start - 1] if start else 0) + size
            stop = max(start + 1, int(np.searchsorted(ends, limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the finaliser of splitmix64)."""
    z = values + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Words:
    """Words ``[^\x20\x09-\x0D]+`` of a batch of texts, in order, as numpy arrays.

    ``counts`` has the words of each text (null: 0), ``begin`` and ``end`` the
    bytes of each word in ``data``, ``hashes`` and ``others`` two independent
    64-bit hashes of each word: the halves of a 128-bit hash of its bytes, which
    is taken once of each distinct word of the batch.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.data, offsets = utf8(texts)
        inside = _IN_WORD[self.data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(inside))]
        first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
        self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.counts = np.diff(np.searchsorted(self.begin, offsets))
        # Without the bytes between words, a word ends where the next begins.
        kept = np.concatenate(([0], np.cumsum(inside)))
        borders = np.append(kept[self.begin], kept[-1]).astype(np.int64)
        letters = self.data[inside]
        buffers = [None, pa.py_buffer(borders), pa.py_buffer(_LOWER[letters] if lower else letters)]
        coded = pa.Array.from_buffers(pa.large_binary(), len(self.begin), buffers).dictionary_encode()
        digests = b"".join(map(xxh3_128_digest, coded.dictionary.to_pylist()))
        halves = np.frombuffer(digests, np.uint64).reshape(-1, 2)[coded.indices.to_numpy()]
        self.hashes, self.others = np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])

    def slice(self, start: int, stop: int) -> bytes:
        return self.data[start:stop].tobytes()


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins, with the end of the last."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))[:-1].astype(np.int64)


def lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One list per text out of flat values."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def map_batches(
    table: DataFrame,
    make: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str,
    size: int = SLICE_BYTES,
) -> DataFrame:
    """``mapInArrow`` over slices of the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size):
            yield make(batch)

    return table.mapInArrow(run, schema)


def plain(table: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names, so that no other column can clash."""
    return table.select(*[F.col(f"`{name}`").alias(alias) for alias, name in columns.items()])


def whole_batches(
    table: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """``mapInArrow`` over the batches as they come."""
    return table.mapInArrow(lambda batches: map(make, batches), schema)
