"""Byte-level BPE against the library, with awkward texts."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from telemill.llm import byte_bpe
from telemill.llm.byte_bpe import (
    DOES,
    JOINT,
    OF_SYMBOL,
    Encoder,
    Ranks,
    decode,
    encode,
    op13_byte_bpe,
    read_ranks,
    round_trip,
    scanned,
    vocabulary_path,
)

ALPHABET = [*"ab1.!'\"= \n\t\r", "  ", "'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'S", "s", "r", "e", "l"]
ALPHABET += ["é", "汉", "٣", " ", " ", "\x1c", "\x85", "😀", "‍", "�", "Ᲊ", "़"]


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(vocabulary_path())


@pytest.fixture(scope="module")
def vocabulary(ranks):
    return Ranks(ranks)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(encoder, texts):
    ids, counts, ends = encoder.encode(pa.array(texts, pa.string()))
    borders = np.concatenate(([0], np.cumsum(counts)))
    return [(ids[a:b].tolist(), ends[a:b].tolist()) for a, b in zip(borders[:-1], borders[1:])]


def equal(encoder, library, texts):
    for text, (ids, ends) in zip(texts, ids_of(encoder, texts)):
        assert ids == library.encode_ordinary(text or ""), repr(text)
        lengths = [len(library.decode_single_token_bytes(i)) for i in ids]
        assert ends == np.cumsum(lengths).tolist()


def test_short_mixtures(vocabulary, library):
    rnd = random.Random(5)
    texts = ["".join(rnd.choices(ALPHABET, k=rnd.randint(0, 12))) for _ in range(20_000)]
    equal(Encoder(vocabulary), library, [*texts, None, "", "'", "''s", " 's", "\n's", "a\n \nb", "  "])


def test_long_pieces(vocabulary, library):
    rnd = random.Random(6)
    texts = ["a" * 3000, "ab" * 700, " " * 900 + "x", "=-" * 500, "9" * 1500, "\n" * 64]
    texts += ["".join(rnd.choices("abcdefgh", k=n)) for n in (63, 64, 65, 2500)]
    texts += ["".join(rnd.choices("汉字é😀", k=300))]
    equal(Encoder(vocabulary), library, texts)


def test_very_long_text_in_linear_time(vocabulary, library):
    text = "The cat's 12 toys, and\n\n  more! " * 60_000  # 1.9 MB
    equal(Encoder(vocabulary), library, [text])


def test_remembers_a_bounded_number(vocabulary, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", len(vocabulary.ranks) + 50)
    rnd, encoder = random.Random(7), Encoder(vocabulary)
    for _ in range(20):
        equal(encoder, library, [" ".join("".join(rnd.choices("abcdxyz", k=9)) for _ in range(40))])
    assert len(encoder.known) < len(vocabulary.ranks) + 200


def test_scan_equals_one_step_at_a_time():
    rnd = np.random.default_rng(8)
    for count in (0, 1, 2, 7, 256, 257, 5000):
        functions = OF_SYMBOL[rnd.integers(0, len(OF_SYMBOL), count)]
        state, want = 0, []
        for f in functions:
            state = DOES[f][state]
            want.append(state)
        assert DOES[scanned(functions, 16), 0].tolist() == want if count else len(scanned(functions)) == 0
    # Composition is associative.
    n = len(JOINT)
    a, b, c = np.ix_(range(n), range(n), range(n))
    assert (JOINT[JOINT[a, b], c] == JOINT[a, JOINT[b, c]]).all()


def test_any_vocabulary(library):
    """Ranks that do not rise with the length of tokens."""
    rnd = random.Random(9)
    tokens = {bytes([b]) for b in range(256)}
    while len(tokens) < 600:
        tokens.add(bytes(rnd.choices(b"abc", k=rnd.randint(2, 6))))
    order = sorted(tokens)
    rnd.shuffle(order)
    ranks = {t: i for i, t in enumerate(order)}
    own = tiktoken.Encoding("any", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["".join(rnd.choices("abc", k=n)) for n in (*range(40), 80, 200, 700) for _ in range(20)]
    equal(Encoder(Ranks(ranks)), own, texts)
    with pytest.raises(ValueError, match="256"):
        Ranks({b"a": 0})


def test_frames(spark, ranks, library):
    texts = [(1, "Hello, world's end"), (2, None), (2, ""), (None, "a  b\n"), (3, "x" * 100_000), (3, "x" * 100_000)]
    docs = spark.createDataFrame([(i, t, 0, "n") for i, t in texts], "doc_id int, text string, ids int, n_tokens string")
    encoded = encode(docs, ranks)
    assert encoded.columns == ["doc_id", "ids", "ends"]
    decoded = decode(encoded, ranks).collect()
    assert sorted(((r["doc_id"], bytes(r["decoded"])) for r in decoded), key=str) == sorted(
        ((i, (t or "").encode()) for i, t in texts), key=str
    )
    for row in encoded.where("doc_id = 1").collect():
        text = texts[0][1].encode()
        cuts = [0, *row["ends"]]
        assert [library.decode_single_token_bytes(i) for i in row["ids"]] == [text[a:b] for a, b in zip(cuts, cuts[1:])]
    assert round_trip(docs.limit(0), ranks).count() == encode(docs.limit(0), ranks).count() == 0


def test_ids_without_a_token_decode_to_nothing(spark, ranks):
    rows = [(1, [64, 50256, None, -1, 65]), (2, None), (3, [])]
    got = decode(spark.createDataFrame(rows, "doc_id int, ids array<int>"), ranks).collect()
    by_rank = {i: t for t, i in ranks.items()}
    assert [bytes(r["decoded"]) for r in got] == [by_rank[64] + by_rank[65], b"", b""]


def test_bytes_that_are_no_text(spark, ranks, library):
    docs = spark.sql("SELECT 1 AS doc_id, cast(X'61FF62' AS string) AS text UNION ALL SELECT 2, 'ok'")
    got = {r["doc_id"]: r["ids"] for r in encode(docs, ranks).collect()}
    assert got == {1: library.encode_ordinary("a�b"), 2: library.encode_ordinary("ok")}


def test_given_table(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op13_byte_bpe(spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row["doc_id"]]
        ids = np.array(library.encode_ordinary(text), "<u4")
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
