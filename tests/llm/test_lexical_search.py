"""Reversed search against a plain ranking, with awkward rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from telemill.llm import lexical_search
from telemill.llm.lexical_search import OP12_SQL, op12_lexical_search, search

DOCS = "doc_id long, text string, item_id long, score string, rank int"
ITEMS = "item_id long, text string, doc_id long, number int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def found(spark, docs, items, **more):
    docs = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in docs], DOCS)
    items = spark.createDataFrame([(i, t, 3, 4) for i, t in items], ITEMS)
    rows = search(docs.repartition(3), items, **more).collect()
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows), key=str)


def expected(docs, items, best=10):
    counted = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        wanted = set(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for i, c in counted:
            m = 10 + (90 * sum(c.values()) * n_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in wanted & c.keys()
            )
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, at + 1, i, -s) for at, (s, _, i) in enumerate(sorted(scores)[:best])]
    return sorted(out, key=str)


AWKWARD = [
    (1, "Apple pie, APPLE tart; naïve café ÉCOLE école"),
    (2, None),
    (3, ""),
    (4, " .,;-- \n\t"),
    (5, "apple apple apple"),
    (6, "apple pie"),
    (7, "apple pie"),
    (7, "apple pie"),
    (None, "apple pie"),
    (8, "über ÜBER 汉字 x\x7fy"),
    (9, "pie " * 5000 + "tart"),
    (10, "snow"),
]
QUESTIONS = [(1, "APPLE pie"), (1, "tart"), (2, None), (3, "?!"), (None, "école"), (4, "汉字 x"), (5, "nowhere"), (6, "pie pie pie")]


def test_equals_plain_ranking(spark):
    assert found(spark, AWKWARD, QUESTIONS) == expected(AWKWARD, QUESTIONS)


def test_ties_go_to_smaller_ids(spark):
    docs = [(i, "same words here") for i in range(40, 0, -1)] + [(i, "other things") for i in range(50, 200)]
    got = found(spark, docs, [(1, "words")], best=4)
    assert got == expected(docs, [(1, "words")], best=4) and {r[2] for r in got} == {1, 2, 3, 4}


@pytest.mark.parametrize("cells, block", [(1, 1), (7, 40), (1 << 21, 8 << 20)])
def test_blocks_of_items_and_documents(spark, monkeypatch, cells, block):
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexical_search, "CELLS", cells)
    rnd = random.Random(2)
    words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(400)]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 30)))) for i in range(120)]
    items = [(i, " ".join(rnd.choices(words, k=5))) for i in range(6)]
    assert found(spark, docs, items, best=3) == expected(docs, items, best=3)


@pytest.mark.parametrize("docs, items", [([], QUESTIONS), (AWKWARD, []), ([(1, None)], QUESTIONS)])
def test_empty_tables(spark, docs, items):
    assert found(spark, docs, items) == []


def test_given_tables_equal_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = op12_lexical_search(spark, folder).orderBy("item_id", "rank").collect()
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = db.execute(f"SELECT * FROM ({OP12_SQL}) ORDER BY item_id, rank").fetchall()
    assert [tuple(r) for r in got] == want


def test_heaps_of_many_tasks_meet_in_groups(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("word"), "id").alias("text"))
    items = spark.createDataFrame([(1, "word 17")], "item_id int, text string")
    rows = search(docs.repartition(40), items, best=3).orderBy("rank").collect()
    assert rows[0]["doc_id"] == 17 and [r["rank"] for r in rows] == [1]  # "word" is in all: weight 0
