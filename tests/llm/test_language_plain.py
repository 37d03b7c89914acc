"""Language identification against naive Bayes worked out text by text."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from telemill.llm import language
from telemill.llm.language import BUCKETS, identify


def plain_grams(text):
    """Buckets of the n-grams of one to three letters and gaps."""
    points = [ord(c) if c.isalpha() else 0 for c in f" {(text or '').lower()} "]
    found = Counter()
    for order in (1, 2, 3):
        for at in range(len(points) - order + 1):
            gram = points[at : at + order]
            if gram[0] or (order > 1 and gram[1]):
                key = 0
                for place, point in enumerate(gram):
                    key = ((key ^ point) * 0x01000193 + place + 1) % 2**32
                found[(key * 0x9E3779B1 % 2**32) >> 17] += 1
    return found


def plain_bayes(learned, texts):
    rows = Counter(label for _, label in learned)
    counts = {label: Counter() for label in rows}
    for text, label in learned:
        counts[label] += plain_grams(text)
    sums = {label: sum(c.values()) + BUCKETS for label, c in counts.items()}
    out = []
    for text in texts:
        grams = plain_grams(text)
        logs = {
            label: math.log(rows[label] / sum(rows.values()))
            + sum(n * math.log((counts[label][g] + 1) / sums[label]) for g, n in grams.items())
            for label in sorted(rows)
        }
        if not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
            continue
        best = max(logs, key=lambda label: (logs[label], [-ord(c) for c in label]))
        out.append((best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())))
    return out


def test_equals_plain_bayes(spark):
    rnd = random.Random(4)
    letters = {"aa": "abcdeé ", "bb": "bcdefü ", "cc": "αβγδ abc", "dd": "汉字abc "}
    rows = []
    for i in range(120):
        label = rnd.choice(list(letters))
        rows.append((i, "".join(rnd.choices(letters[label], k=rnd.randint(0, 30))), label))
    rows += [(200, None, "aa"), (201, "12 34", "bb"), (202, "abc", None), (203, "abc", "aa"), (203, "abc", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = F.col("doc_id") % 3 != 0
    got = sorted((r.doc_id, r.lang_pred, round(r.score, 4)) for r in identify(docs, learn).collect())
    learned = [(t, label) for i, t, label in rows if i % 3 and t is not None and label is not None]
    found = plain_bayes(learned, [t for _, t, _ in rows])
    want = sorted((i, label, round(score, 4)) for (i, _, _), (label, score) in zip(rows, found))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=2e-4)


def test_a_label_without_grams(spark):
    docs = spark.createDataFrame([(1, "abc", "aa"), (2, "123", "bb"), (3, "abc", None)], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in identify(docs, F.lit(True)).collect()}
    assert rows[3].lang_pred == rows[1].lang_pred == "aa" and rows[2].lang_pred == "und"


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "abc " * 40_000, "aa"), (2, "xyz " * 40_000, "bb"), (3, "xyz", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in identify(docs, F.lit(True)).collect()}
    assert got == {1: "aa", 2: "bb", 3: "bb"} and language.BUCKETS < 160_000
