"""Byte-level BPE: texts cut into pieces by array operations, pieces merged pair by pair, ids decoded.

The cut needs no regular expression. Each character has a class and, with the
characters behind it, a symbol; a symbol is a function from the state before it
to the state after it. These functions compose associatively, so the state at
every character of a batch comes out of one scan over all of them, block by
block; a character begins a piece where its state and symbol say so. Distinct
pieces of a batch are merged together, one pair of each in a round, and
remembered; the ends of tokens in their text stay with the ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from telemill.llm.words import lists, map_batches, plain, starts_of, utf8, whole_batches

# Texts are worked on in slices of about this many bytes: few equal pieces are met twice.
SLICE_BYTES = 1 << 21
REMEMBERED = 1 << 19  # pieces a task remembers, and 16 times as many ids
LONG = 64  # bytes of a piece from which pairs are merged from a heap
NONE = np.iinfo(np.int32).max  # rank of a pair that is no token

# Classes of code points.
OTHER, LETTER, NUMBER, WHITE, SPACE = range(5)

# Symbols: a character and what its text goes on with. APOSTROPHE_1 and _2 are followed by the
# one or two letters of a contraction; white space is inside a run (or the run ends the text),
# or the last before another character.
(LETTERS, NUMBERS, OTHERS, APOSTROPHE_1, APOSTROPHE_2, INSIDE, LAST_SPACE, LAST_WHITE) = range(8)
SYMBOLS = 8

# States: what the last piece is so far. A space may head the piece behind it; a contraction
# needs one or two letters more; DONE also stands before the first character of a text.
DONE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_WHITE, NEEDS_1, NEEDS_2 = range(8)
STATES = 8


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """The state behind and whether a piece begins, by state before and symbol."""
    after = np.zeros((STATES, SYMBOLS), np.uint8)
    begins = np.ones((STATES, SYMBOLS), bool)
    for symbol, run in ((LETTERS, IN_LETTERS), (NUMBERS, IN_NUMBERS), (OTHERS, IN_OTHERS)):
        after[:, symbol] = run
        begins[[run, AFTER_SPACE], symbol] = False
    for symbol, needs in ((APOSTROPHE_1, NEEDS_1), (APOSTROPHE_2, NEEDS_2)):
        after[:, symbol] = needs
        after[[IN_OTHERS, AFTER_SPACE], symbol] = IN_OTHERS
        begins[[IN_OTHERS, AFTER_SPACE], symbol] = False
    after[NEEDS_2, LETTERS], after[NEEDS_1, LETTERS] = NEEDS_1, DONE
    begins[[NEEDS_2, NEEDS_1], LETTERS] = False
    after[:, INSIDE] = after[:, LAST_WHITE] = IN_WHITE
    begins[IN_WHITE, INSIDE] = False
    after[:, LAST_SPACE] = AFTER_SPACE
    return after, begins


AFTER, BEGINS = _machine()


def _functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of symbols: what each does to a state, the table of compositions, the symbols' own.

    The second half of the symbols are first in their text: they forget the state before.
    """
    symbols = [tuple(AFTER[:, s]) for s in range(SYMBOLS)]
    symbols += [(AFTER[DONE, s],) * STATES for s in range(SYMBOLS)]
    known = {tuple(range(STATES)): 0}  # nothing changes: fills up the last block
    queue = list(known)
    for function in queue:
        for symbol in symbols:
            both = tuple(symbol[x] for x in function)
            if both not in known:
                known[both] = len(known)
                queue.append(both)
    does = np.array(list(known), np.uint8)
    joint = [[known[tuple(does[b][does[a]])] for b in range(len(known))] for a in range(len(known))]
    return does, np.array(joint, np.uint8), np.array([known[s] for s in symbols], np.uint8)


DOES, JOINT, OF_SYMBOL = _functions()


def scanned(functions: np.ndarray, block: int = 256) -> np.ndarray:
    """All functions up to and with each place, composed: in blocks side by side, then over the blocks."""
    count, size = len(functions), len(JOINT)
    if count <= 1:
        return functions
    joint, rows = JOINT.ravel(), -(-count // block)
    table = np.zeros(rows * block, np.uint8)
    table[:count] = functions
    table = np.ascontiguousarray(table.reshape(rows, block).T)
    for j in range(1, block):
        table[j] = joint[table[j - 1].astype(np.intp) * size + table[j]]
    if rows > 1:
        before = scanned(table[-1, :-1], block).astype(np.intp)
        table[:, 1:] = joint[before * size + table[:, 1:]]
    return table.T.ravel()[:count]


def begins(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each code point; ``first`` tells those that begin a text."""
    count = len(points)
    kind = classes[points]

    def ahead(by: int) -> np.ndarray:
        """Code points further on in the same text, else 0."""
        out = np.zeros(count, points.dtype)
        out[: count - by] = points[by:]
        for i in range(1, by + 1):
            out[: count - i][first[i:]] = 0
        return out

    blank = kind >= WHITE
    last = np.zeros(count, bool)
    last[:-1] = ~blank[1:] & ~first[1:]
    symbol = np.array([OTHERS, LETTERS, NUMBERS, INSIDE, INSIDE], np.uint8)[kind]
    symbol[last & (kind == WHITE)] = LAST_WHITE
    symbol[last & (kind == SPACE)] = LAST_SPACE
    marks = np.flatnonzero(points == ord("'"))
    if len(marks):
        one, two = ahead(1)[marks], ahead(2)[marks]
        symbol[marks[np.isin(one, [ord(c) for c in "stmd"])]] = APOSTROPHE_1
        for a, b in ("re", "ve", "ll"):
            symbol[marks[(one == ord(a)) & (two == ord(b))]] = APOSTROPHE_2
    state = DOES[scanned(OF_SYMBOL[symbol + SYMBOLS * first.astype(np.uint8)]), DONE]
    before = np.full(count, DONE, np.uint8)
    before[1:] = state[:-1]
    before[first] = DONE
    return BEGINS[before, symbol]


def pieces(texts: pa.Array, classes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Pieces of all texts in order, as bytes, and how many each text has."""
    data, offsets = utf8(texts)
    try:
        text = data.tobytes().decode()
    except UnicodeDecodeError:  # bytes that are no text count as U+FFFD
        texts = [(b or b"").decode("utf-8", "replace") for b in texts.cast(pa.binary()).to_pylist()]
        return pieces(pa.array(texts, pa.large_string()), classes)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    place = np.flatnonzero((data & 0xC0) != 0x80)  # bytes at which code points begin
    first = np.zeros(len(points) + 1, bool)
    first[np.searchsorted(place, offsets[:-1])] = True
    cuts = place[begins(points, first[:-1], classes)] if len(points) else place
    counts = np.diff(np.searchsorted(cuts, offsets))
    borders = pa.py_buffer(np.append(cuts, len(data)).astype(np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, borders, pa.py_buffer(data)]), counts


class Ranks:
    """A vocabulary: bytes of ids, ids of pairs in an open hash table, classes of code points.

    Goes to the tasks as a broadcast whose size is that of the vocabulary file.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary has all 256 bytes")
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        by_id = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        self.lengths = np.array([len(token) for token in by_id])
        self.starts = starts_of(self.lengths)
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        halves = [(ranks.get(t[:i]), ranks.get(t[i:]), r) for t, r in ranks.items() for i in range(1, len(t))]
        left, right, rank = np.array([h for h in halves if None not in h[:2]] or np.zeros((0, 3)), np.int64).T
        self._table(left << 32 | right, rank.astype(np.int32))
        self.classes = code_point_classes()

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.shift = 64 - max(2 * len(keys), 2).bit_length()
        self.keys = np.full(1 << (64 - self.shift), -1, np.int64)
        self.values = np.full(len(self.keys), NONE, np.int32)
        slots, waiting = self._slots(keys), np.arange(len(keys))
        while len(waiting):
            free = self.keys[slots[waiting]] == -1
            self.keys[slots[waiting[free]]] = keys[waiting[free]]
            placed = self.keys[slots[waiting]] == keys[waiting]
            self.values[slots[waiting[placed]]] = values[waiting[placed]]
            waiting = waiting[~placed]
            slots[waiting] = (slots[waiting] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each pair put together, NONE if it is no token."""
        keys = (left.astype(np.int64) << 32 | right).ravel()
        slots = self._slots(keys)
        there = self.keys[slots]
        out = self.values[slots]
        open_ = np.flatnonzero((there != keys) & (there != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & (len(self.keys) - 1)
            there = self.keys[slots[open_]]
            out[open_] = self.values[slots[open_]]
            open_ = open_[(there != keys[open_]) & (there != -1)]
        # An empty slot holds NONE, so a key that is missing has it too.
        return out.reshape(left.shape)


def code_point_classes() -> np.ndarray:
    """The class of every code point, by the Unicode tables of the library whose ids are asked for."""
    import tiktoken

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
    singles = {bytes([b]): b for b in range(256)}
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        matching = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=singles, special_tokens={})
        found = bytes(matching.encode_ordinary(every)).decode().encode("utf-32-le")
        out[np.frombuffer(found, np.uint32)] = kind
    out[ord(" ")] = SPACE
    return out


class Encoder:
    """Ids of texts; remembers the ids of pieces, a bounded number of them."""

    def __init__(self, vocabulary: Ranks):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        """Start from the pieces that are tokens themselves."""
        self.known = {token: i for i, token in enumerate(self.vocabulary.ranks)}
        self.ids = np.fromiter(self.vocabulary.ranks.values(), np.int32, len(self.known))
        self.starts = np.arange(len(self.known))
        self.counts = np.ones(len(self.known), np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in order, how many each has, and the byte of its text where each token ends."""
        cut, per_text = pieces(texts, self.vocabulary.classes)
        if len(self.known) > REMEMBERED or len(self.ids) > 16 * REMEMBERED:
            self.forget()
        distinct = cut.dictionary_encode()
        at = self._places(distinct.dictionary.to_pylist())[distinct.indices.to_numpy()]
        counts = self.counts[at]
        flat = self.ids[runs(self.starts[at], counts)]
        ends = np.concatenate(([0], np.cumsum(counts)))
        per_text = np.diff(ends[np.concatenate(([0], np.cumsum(per_text)))])
        return flat, per_text, token_ends(self.vocabulary.lengths[flat], per_text)

    def _places(self, wanted: list[bytes]) -> np.ndarray:
        new = [piece for piece in wanted if piece not in self.known]
        if new:
            new.sort(key=len)
            ids, counts = merged(new, self.vocabulary)
            base = len(self.starts)
            self.known.update(zip(new, range(base, base + len(new))))
            self.starts = np.concatenate((self.starts, len(self.ids) + starts_of(counts)))
            self.counts = np.concatenate((self.counts, counts))
            self.ids = np.concatenate((self.ids, ids))
        return np.fromiter(map(self.known.__getitem__, wanted), np.int64, len(wanted))


def merged(new: list[bytes], vocabulary: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces that are sorted by length, and how many each has."""
    lengths = np.fromiter(map(len, new), np.int64, len(new))
    data = vocabulary.single[np.frombuffer(b"".join(new), np.uint8)]
    counts, parts = np.empty(len(new), np.int64), []
    short = int(np.searchsorted(lengths, LONG))
    begin = starts_of(lengths)
    for length in np.unique(lengths[:short]):
        a, b = np.searchsorted(lengths, [length, length + 1])
        block = data[begin[a] : begin[a] + length * (b - a)].reshape(b - a, length)
        ids, counts[a:b] = merged_together(block, vocabulary)
        parts.append(ids)
    for i in range(short, len(new)):
        ids = merged_from_heap(data[begin[i] : begin[i] + lengths[i]].tolist(), vocabulary)
        counts[i] = len(ids)
        parts.append(np.array(ids, np.int32))
    return np.concatenate(parts), counts


def merged_together(ids: np.ndarray, vocabulary: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of one length, a row each: in a round, each merges its leftmost pair of least rank.

    A row loses one column a round, or is done.
    """
    total, width = ids.shape
    out = np.empty((total, width), np.int32)
    counts = np.empty(total, np.int64)
    rank, row = vocabulary.pair(ids[:, :-1], ids[:, 1:]), np.arange(total)
    while len(row):
        width = ids.shape[1]
        if width == 1:
            out[row, :1], counts[row] = ids, 1
            break
        at = rank.argmin(axis=1)
        best = rank[np.arange(len(row)), at]
        going = best != NONE
        done = row[~going]
        out[done, :width], counts[done] = ids[~going], width
        ids, rank, row, at, best = ids[going], rank[going], row[going], at[going], best[going]
        every, columns = np.arange(len(row)), np.arange(width)
        ids = ids[columns != at[:, None] + 1].reshape(len(row), width - 1)
        ids[every, at] = best
        rank = rank[columns[:-1] != at[:, None]].reshape(len(row), width - 2)
        for change, fits in ((at - 1, at > 0), (at, at < width - 2)):
            r, c = every[fits], change[fits]
            rank[r, c] = vocabulary.pair(ids[r, c], ids[r, c + 1])
    inside = np.arange(out.shape[1]) < counts[:, None]
    return out[inside], counts


def merged_from_heap(ids: list[int], vocabulary: Ranks) -> list[int]:
    """One long piece: pairs by rank and place from a heap, parts linked to their neighbours."""
    after = [*range(1, len(ids)), -1]
    before = list(range(-1, len(ids) - 1))
    pairs = vocabulary.pair(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist()
    heap = [(rank, i) for i, rank in enumerate(pairs) if rank != NONE]
    heapq.heapify(heap)
    current = [*pairs, int(NONE)]
    ranks, starts, lengths = vocabulary.ranks, vocabulary.starts, vocabulary.lengths
    part = [vocabulary.bytes[starts[i] : starts[i] + lengths[i]].tobytes() for i in ids]

    def renew(i: int) -> None:
        rank = ranks.get(part[i] + part[after[i]], int(NONE)) if i >= 0 and after[i] >= 0 else int(NONE)
        if i >= 0:
            current[i] = rank
            if rank != NONE:
                heapq.heappush(heap, (rank, i))

    while heap:
        rank, i = heapq.heappop(heap)
        if current[i] != rank:
            continue
        j = after[i]
        ids[i], part[i] = rank, part[i] + part[j]
        after[i], current[j], ids[j] = after[j], int(NONE), -1
        if after[j] >= 0:
            before[after[j]] = i
        renew(i)
        renew(before[i])
    return [x for x in ids if x >= 0]


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), then those of the next."""
    return np.repeat(starts - starts_of(counts), counts) + np.arange(counts.sum())


def token_ends(lengths: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Where tokens end, counted from the begin of their text."""
    ends = np.concatenate(([0], np.cumsum(lengths)))
    return ends[1:] - np.repeat(ends[starts_of(per_text)], per_text)


def decode_flat(ids: np.ndarray, per_text: np.ndarray, vocabulary: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in order, and where each begins, with the end of the last; unknown ids have no bytes."""
    known = (ids >= 0) & (ids < len(vocabulary.lengths))
    ids = np.where(known, ids, 0)
    lengths = np.where(known, vocabulary.lengths[ids], 0)
    data = vocabulary.bytes[runs(vocabulary.starts[ids], lengths)]
    ends = np.concatenate(([0], np.cumsum(lengths)))
    return data, ends[np.concatenate(([0], np.cumsum(per_text)))]


def _encoded(shared, finish: Callable) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    state: list[Encoder] = []

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.append(Encoder(shared.value))
        return finish(batch, *state[0].encode(batch["text"]))

    return make


def encode(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, ends`` of each text, a row for each row.

    ``ends`` are the bytes of the text at which its tokens end, so that ids
    a to b decode to bytes ends[a - 1] to ends[b]. Null and empty texts have no
    ids. Ids of documents may be null or repeated; other columns are not looked
    at; an empty table gives an empty result. There is no shuffle, and what a
    task remembers is bounded.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Ranks(ranks))
    docs = plain(docs, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(batch: pa.RecordBatch, ids: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        columns = [batch["doc_id"], lists(ids, counts, pa.int32()), lists(ends, counts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "ends"])

    schema = f"doc_id {kind}, ids array<int>, ends array<bigint>"
    return map_batches(docs, _encoded(shared, finish), schema, SLICE_BYTES)


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``doc_id, ids, decoded``: the bytes of ids; null or no ids give no bytes, as ids do that no token has."""
    shared = encoded.sparkSession.sparkContext.broadcast(Ranks(ranks))
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = pc.fill_null(pc.list_value_length(batch["ids"]), 0).to_numpy(zero_copy_only=False)
        ids = pc.fill_null(pc.list_flatten(batch["ids"]), -1).to_numpy(zero_copy_only=False)
        data, offsets = decode_flat(ids, counts, shared.value)
        buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
        out = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, buffers).cast(pa.binary())
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["ids"], out], names=["doc_id", "ids", "decoded"])

    return whole_batches(encoded.select("doc_id", "ids"), make, f"doc_id {kind}, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of :func:`encode` and :func:`decode`.

    Both in one pass over the texts, so that no ids leave the task. Ids are
    digested as little-endian unsigned 32-bit numbers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Ranks(ranks))
    docs = plain(docs, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digests(data: np.ndarray, ends: np.ndarray) -> pa.Array:
        view = memoryview(np.ascontiguousarray(data)).cast("B")
        pairs = zip(ends[:-1].tolist(), ends[1:].tolist())
        return pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in pairs], pa.string())

    def finish(batch: pa.RecordBatch, ids: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        decoded = decode_flat(ids, counts, shared.value)
        borders = 4 * np.concatenate(([0], np.cumsum(counts)))
        columns = [batch["doc_id"], pa.array(counts), digests(ids.astype("<u4"), borders), digests(*decoded)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs, _encoded(shared, finish), schema, SLICE_BYTES)


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a file with a token in base64 and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def vocabulary_path() -> str:
    """The public vocabulary file of the installation."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op13_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, read_ranks(vocabulary_path()))
