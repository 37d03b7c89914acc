"""Words and texts that were once taken for equal, texts of very many spans, repeated and missing ids."""

from __future__ import annotations

import random
import time

import pytest

from telemill.llm import pii, secrets, stages
from telemill.llm.near_dedup import near_duplicates
from telemill.llm.substring_dedup import repeated_passages
from tests.llm import brute


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("length", [1024, 4096])
def test_complementary_words_differ(spark, length):
    one, two = brute.thue_morse(length)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join([*words[:20], x, *words[20:]]) for x in (one, two)] + [" ".join(("a", "b", x)) for x in (one, two)]
    docs = frame(spark, list(enumerate(texts)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeated_passages(docs).collect()}
    assert got == dict(enumerate(brute.without_repeats(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, shingle=2).collect()}
    assert got == brute.near_groups(dict(enumerate(texts)))


def mixed(count, rnd):
    parts = [lambda: f"1.2.3.{rnd.randint(0, 300)}", lambda: "a@b.cd", lambda: "+49 (0)30 123456", lambda: "wörd é😀"]
    return " ; ".join(rnd.choice(parts)() for _ in range(count))


@pytest.mark.parametrize("count", [1, 62, 64, 66, 130, 1500])
def test_spans_of_any_number_equal_plain_ones(spark, count):
    rnd = random.Random(count)
    text = mixed(count, rnd)
    row = pii.personal_data(frame(spark, [(1, text)]), with_text=True).first()
    want = brute.personal(text)
    assert row.base_sha256 == brute.digest(f"{kind}:{start}:{end}" for _, start, kind, end in want)
    clean, at = "", 0
    for _, start, kind, end in sorted(want, key=lambda s: (s[1], s[0])):
        if start >= at:
            clean += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    assert row.clean_text == clean + text[at:]


def test_secrets_of_any_number_are_replaced(spark):
    text = " ".join(f"token={i:08d}x" for i in range(700))
    docs = frame(spark, [(1, text), (2, "token=00000001x"), (3, None)])
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert clean == {1: " ".join(["[SECRET]"] * 700), 2: "[SECRET]", 3: None}
    rows = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert rows[1].n_assign == 700
    assert rows[1].base_sha256 == brute.digest(f"{k}:{s}:{e}" for s, _, k, e in brute.secrets(text))


def test_a_hundred_thousand_spans_end(spark):
    text = " ".join(["10.0.0.1"] * 100_000)
    begin = time.time()
    assert pii.personal_data(frame(spark, [(1, text)])).first().n_ip == 100_000
    assert time.time() - begin < 240


def test_copies_leave_one_row(spark):
    rows = [(1, "same"), (1, "same"), (None, "same"), (None, "other"), (None, "other"), (2, "x"), (2, "y"), (3, "x")]
    rows += [(4, None), (5, ""), (4, None)]
    kept = [tuple(r) for r in stages.without_copies(spark, frame(spark, rows), "").collect()]
    assert sorted(kept, key=str) == sorted([(1, "same"), (None, "other"), (2, "y"), (3, "x"), (5, "")], key=str)


def test_unrelated_texts_of_an_id_stay(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base + " more"), (2, "something else entirely"), (None, base), (3, None), (4, "")]
    kept = [tuple(r) for r in stages.without_near_copies(spark, frame(spark, rows), "").collect()]
    assert len(kept) == 5 and (2, "something else entirely") in kept and (None, base) in kept
    single = [(1, base), (2, base + " more"), (5, "alone")]
    kept = [tuple(r) for r in stages.without_near_copies(spark, frame(spark, single), "").collect()]
    assert sorted(kept) == [(1, base), (5, "alone")]


@pytest.mark.parametrize("listed", [0, 1_000_000])
def test_decisions_of_any_size_take_effect(spark, monkeypatch, listed):
    monkeypatch.setattr(stages, "LISTED", listed)
    monkeypatch.setattr(pii, "LISTED", listed)
    docs = frame(spark, [(i, f"text {i % 3}") for i in range(9)])
    assert sorted(r.doc_id for r in stages.without_copies(spark, docs, "").collect()) == [6, 7, 8]
    people = [(i, f"Zwiebelfisch writes to a{i % 2}@b.cd number {i}") for i in range(8)] + [(9, "nothing " + "x " * i) for i in range(30)]
    spans = {r.doc_id: r.spans for r in pii.personal_data(frame(spark, people)).collect()}
    assert all("email:" in spans[i] for i in range(8))


def test_empty_tables_and_missing_columns(spark):
    docs = frame(spark, [])
    for stage in (stages.without_copies, stages.without_near_copies, stages.without_secrets):
        assert stage(spark, docs, "").count() == 0
