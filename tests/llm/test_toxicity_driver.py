"""The driver keeps the terms of the examples as plain arrays, and searches nothing."""

from __future__ import annotations

import pickle
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemill.llm import toxicity
from telemill.llm.toxicity import ExampleIndex, score_toxicity


def examples(spark):
    words = ["plain", "quiet", "window", "garden", "river", "market", "letter", "silver"]
    texts = [(i, " ".join(words[(i + k) % 8] for k in range(4)) + (" vermosk" if i % 4 == 0 else "")) for i in range(60)]
    texts += [(60, None), (61, ""), (62, "zzz")]
    labels = [(i, int(i % 4 == 0)) for i in range(62)]
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_no_blocks_are_built_on_the_driver(spark, monkeypatch):
    docs, labels = examples(spark)
    want = {r.doc_id: r for r in score_toxicity(docs, labels, F.lit(True)).collect()}

    def refuse(self):
        raise AssertionError("the driver searches")

    # Workers import the module by themselves, so this holds for the driver only.
    monkeypatch.setattr(ExampleIndex, "_build", refuse)
    got = {r.doc_id: r for r in score_toxicity(docs, labels, F.lit(True)).collect()}
    assert got == want
    assert got[60].evidence == got[61].evidence == got[62].evidence == []
    assert min(got[i].score for i in range(0, 60, 4)) > max(got[i].score for i in range(60) if i % 4)


def random_rows(count=400, size=5000, each=200):
    rng = np.random.default_rng(3)
    terms = [np.sort(rng.choice(size, each, replace=False)).astype(np.int32) for _ in range(count)]
    return [(i, i % 2, t, rng.integers(1, 9, each, dtype=np.int32)) for i, t in enumerate(terms)]


def test_index_on_the_driver_is_small():
    rows, idf = random_rows(), np.linspace(1, 9, 5000)
    entries = sum(len(r[2]) for r in rows)
    tracemalloc.start()
    index = ExampleIndex(rows, idf, (1.0, 1.0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 * entries
    assert len(pickle.dumps(index)) < 9 * entries + 8 * len(idf) + 10_000


def test_index_of_arrays_equals_that_of_lists():
    rows, idf = random_rows(60, 90, 12), np.linspace(1, 9, 90)
    rows += [(60, 0, np.zeros(0, np.int32), np.zeros(0, np.int32)), (61, 1, rows[3][2], rows[3][3]), (62, 1, rows[3][2][:5], rows[3][3][:5])]
    arrays = ExampleIndex(rows, idf, (1.0, 1.0), 8)
    lists = ExampleIndex([(i, label, t.tolist(), n.tolist()) for i, label, t, n in rows], idf, (1.0, 1.0), 8)
    order = sorted(((t.tolist(), label, str(i)), i) for i, label, t, _ in rows if len(t))
    assert arrays.ids == lists.ids == [i for _, i in order]
    found = [index.nearest(index.features, index.counts, 7, list(range(len(index.ids)))) for index in (arrays, lists)]
    assert all((one == other).all() for one, other in zip(*found))


@pytest.mark.parametrize("labels", [0, 1])
def test_labels_of_one_class_or_none(spark, labels):
    docs, _ = examples(spark)
    table = spark.createDataFrame([(i, 1) for i in range(labels * 9)], "doc_id long, toxic int")
    scores = [r.score for r in score_toxicity(docs, table, F.lit(True)).collect()]
    assert len(scores) == 63 and all(0 <= s <= 1 for s in scores)
