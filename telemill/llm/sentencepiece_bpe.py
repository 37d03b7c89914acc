"""SentencePiece encoding and decoding by a Viterbi pass that words share by prefix.

The distinct marked words of a batch are sorted, which is the depth-first order
of their trie; a word goes on from the forward states of the characters it
shares with the word before. A state of a prefix is its best last piece. For a
unigram model that is the piece of the largest total score. A merge model
admits a piece only after pieces with which it stays unmerged, which leaves one
path: the library's own result.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.words import lists, map_batches, plain, starts_of, utf8, whole_batches

MARK = "▁"
NORMAL, BYTE, UNIGRAM = 1, 6, 1
#: Words and piece pairs that a task remembers between batches.
REMEMBERED = 600_000
#: Bytes of text whose words are sorted together.
SLICE_BYTES = 2 << 20


class Pieces:
    """The pieces of a model file, as plain tables that travel to the tasks."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as file:
            model.ParseFromString(file.read())
        normal = model.normalizer_spec
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces:
            raise ValueError("only models without text normalisation are read")
        self.prefix = MARK if normal.add_dummy_prefix else ""
        self.unigram = model.trainer_spec.model_type == UNIGRAM
        self.pieces = [p.piece for p in model.pieces]
        self.scores = [p.score for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        bytes_ = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.bytes = [bytes_[b] for b in range(256)]
        # What each id stands for.
        self.texts = [piece.replace(MARK, " ").encode() for piece in self.pieces]
        for value, i in enumerate(self.bytes):
            self.texts[i] = bytes([value])
        self.check()

    def check(self) -> None:
        """Words can be taken one by one only if no piece goes across their borders."""
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            raise ValueError("a piece joins the end of a word and the next word")
        # Every ending of a piece, with its id if it is a piece itself.
        self.endings = {p[i:]: self.ids.get(p[i:], -1) for p in self.ids for i in range(len(p))}
        self.breaks = "".join(c for c in "\n\t\r" if not any(c in piece for piece in self.ids))


class Encoder:
    """Encodes words in sorted order; remembers pairs of pieces and recent words within a bound."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str) -> list[str]:
        """The merge rule on a short text: the best pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                j = self.p.ids.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or self.p.scores[j] > best):
                    best, at = self.p.scores[j], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def admits(self, last: int, piece: int) -> bool:
        """Whether a merge model leaves a piece unmerged behind another, or at the start (``last`` -1)."""
        if len(self.pairs) > REMEMBERED:
            self.pairs.clear()
        right = self.p.pieces[piece]
        whole = [right] if last < 0 else [self.p.pieces[last], right]
        good = self.pairs[(last + 1) * len(self.p.pieces) + piece] = self.merged("".join(whole)) == whole
        return good

    def encode_sorted(self, words: list[str]) -> None:
        """Encode sorted words into ``self.words``.

        ``last`` has the last piece of each prefix (-1: none, since the prefix
        is empty or ends in a character without a piece), ``begin`` where that
        piece begins, ``total`` the score so far.
        """
        endings, scores, unigram = self.p.endings, self.p.scores, self.p.unigram
        pairs, size, worst = self.pairs, len(self.p.pieces), min(self.p.scores) - 10
        before = ""
        last, begin, total = [-1], [0], [0.0]
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], begin[shared + 1 :], total[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                options = []
                start = end - 1
                while start >= 0:
                    piece = endings.get(word[start:end])
                    if piece is None:
                        break
                    if piece >= 0:
                        options.append((start, piece))
                    start -= 1
                found, at, score = -1, end - 1, worst
                if unigram:
                    options.sort(key=lambda o: total[o[0]] + scores[o[1]])
                for start, piece in reversed(options):
                    good = unigram or pairs.get((last[start] + 1) * size + piece)
                    if good is None:
                        good = self.admits(last[start], piece)
                    if good:
                        found, at, score = piece, start, scores[piece]
                        break
                last.append(found)
                begin.append(at)
                total.append(total[at] + score)
            out, end = [], len(word)
            while end:
                if last[end] >= 0:
                    out.append(last[end])
                else:
                    out.extend(self.p.bytes[b] for b in reversed(word[begin[end] : end].encode()))
                end = begin[end]
            self.words[word] = tuple(out[::-1])
            before = word

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and their number in each text."""
        units, counts = marked_words(texts, self.p)
        coded = units.dictionary_encode()
        distinct = [w.replace(" ", MARK) for w in coded.dictionary.to_pylist()]
        new = [w for w in distinct if w not in self.words]
        if len(self.words) + len(new) > REMEMBERED:
            self.words.clear()
            new = distinct
        self.encode_sorted(sorted(new))
        own = [self.words[w] for w in distinct]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        flat = np.fromiter(chain.from_iterable(own), np.int32, int(sizes.sum()))
        index = coded.indices.to_numpy()
        ids = flat[ranges(starts_of(sizes)[index], sizes[index])]
        ends = np.concatenate(([0], np.cumsum(sizes[index])))
        borders = np.concatenate(([0], np.cumsum(counts)))
        return ids, np.diff(ends[borders])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``starts``, one range behind the other."""
    return np.repeat(starts - starts_of(sizes), sizes) + np.arange(sizes.sum())


def marked_words(texts: pa.Array, pieces: Pieces) -> tuple[pa.Array, np.ndarray]:
    """Words with the blanks before them, of all texts in order, and their number in each.

    A blank stands for the mark. Characters that no piece has are words of
    their own, so that they do not make new words out of known ones.
    """
    texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
    if pieces.prefix:
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
    data, offsets = utf8(texts)
    blank = data == 0x20
    single = np.isin(data, np.frombuffer(pieces.breaks.encode(), np.uint8))
    first = blank.copy()
    first[1:] &= ~blank[:-1]
    first |= single
    first[1:] |= single[:-1]
    first[offsets[offsets < len(data)]] = True
    begin = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(begin, offsets))
    borders = pa.py_buffer(np.append(begin, len(data)).astype(np.int64))
    return pa.LargeStringArray.from_buffers(len(begin), borders, pa.py_buffer(data)), counts


def decode(ids: np.ndarray, counts: np.ndarray, pieces: Pieces) -> list[str]:
    """Texts of ids; the blank that encoding put in front of each goes."""
    ends = np.concatenate(([0], np.cumsum(counts)))
    out = []
    for a, b in zip(ends[:-1], ends[1:]):
        text = b"".join(map(pieces.texts.__getitem__, ids[a:b].tolist()))
        out.append((text[1:] if pieces.prefix and text[:1] == b" " else text).decode("utf-8", "replace"))
    return out


def _encoded(shared, also_text: bool = False):
    state: list[Encoder] = []

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.append(Encoder(shared.value))
        ids, counts = state[0].encode(batch["text"])
        out = [batch["doc_id"], lists(ids, counts, pa.int32())]
        if also_text:
            out.append(pa.array(decode(ids, counts, shared.value), pa.string()))
        return pa.RecordBatch.from_arrays(out, names=["doc_id", "ids", "text"][: len(out)])

    return make


def _checked(shared):
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch["ids"]
        texts = decode(ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy()), shared.value)
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"]
        )

    return make


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each text: ``doc_id, ids``, a row for each row.

    Null and empty texts have no ids. Characters without a piece become their
    bytes. Ids of documents may be null or repeated; other columns are not
    looked at; an empty table gives an empty result. The model goes to the
    tasks as a table of its pieces, whose size is that of the model file; there
    is no shuffle, and what a task remembers is bounded.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(model_file))
    docs = plain(docs, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, _encoded(shared), f"doc_id {kind}, ids array<int>", SLICE_BYTES)


def decoded(encoded: DataFrame, model_file: str) -> DataFrame:
    """Texts of ids: ``doc_id, ids, text``; no ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces(model_file))
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return whole_batches(encoded, _checked(shared), f"doc_id {kind}, ids array<int>, text string")


def round_trip(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each text and the text that they decode to: ``doc_id, ids, text``, in one pass over the texts.

    Same rows as :func:`decoded` of :func:`encode`, with half as many Python workers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(model_file))
    docs = plain(docs, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>, text string"
    return map_batches(docs, _encoded(shared, also_text=True), schema, SLICE_BYTES)


def model_path() -> str:
    """The public model file of the installation."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """All documents encoded, and the digest of what their ids decode to."""
    model = model_path()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, model).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_ids"),
        "ids",
        F.sha2("text", 256).alias("decoded_sha256"),
    )
