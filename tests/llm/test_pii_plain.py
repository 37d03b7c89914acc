"""Terms that give values away, against counts of whole documents worked out plainly."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

from telemill.llm.pii import DISCLOSURE, SUPPORT, personal_data
from tests.llm import brute

TERM = re.compile(r"[^\W\d_]{4,}")


def plain_spans(texts):
    """The spans of each text, base ones by kind, then terms."""
    base = [brute.personal(t) for t in texts]
    free = []
    for text, spans in zip(texts, base):
        chars = list(text or "")
        for _, start, _, end in spans:
            chars[start:end] = " " * (end - start)
        free.append("".join(chars))
    words = [{m[0].lower() for m in TERM.finditer(f)} for f in free]
    entities = [{(k, t[s:e]) for _, s, k, e in spans} for t, spans in zip(texts, base)]
    n_entity = Counter(x for some in entities for x in some)
    n_term = Counter(w for some in words for w in some)
    both, different = Counter(), defaultdict(set)
    for text, some, own in zip(texts, words, entities):
        for entity in own:
            different[entity].add(text)
            for word in some:
                both[entity, word] += 1
                different[entity, word].add(text)
    flagged = {
        word
        for (entity, word), n in both.items()
        if len(different[entity, word]) >= SUPPORT
        and len(different[entity]) >= SUPPORT
        and math.log(n / n_term[word]) >= (DISCLOSURE - 1) * math.log(len(texts) / n_entity[entity])
    }
    out = []
    for spans, text in zip(base, free):
        terms = [f"term:{m.start()}:{m.end()}" for m in TERM.finditer(text) if m[0].lower() in flagged]
        out.append(",".join([f"{k}:{s}:{e}" for _, s, k, e in spans] + terms))
    return out, flagged


def test_terms_equal_plain_counts(spark):
    rnd = random.Random(11)
    common = ["where", "there", "Straße", "other", "again"]
    texts = []
    for i in range(160):
        parts = rnd.choices(common, k=6)
        person = i % 8
        if person < 5:  # a name that mostly stands with its address
            parts.insert(rnd.randint(0, 6), f"Name{'abcde'[person]}x")
            if rnd.random() < 0.85:
                parts.insert(rnd.randint(0, 6), f"p{person}@mail.org")
        if rnd.random() < 0.1:
            parts.append("10.0.0.1")
        texts.append(" ".join(parts) + f" {i % 50}")
    texts += [texts[0]] * 12 + ["Nameax alone", None, "", "NAMEBX once more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, flagged = plain_spans(texts)
    assert flagged and flagged != {m for t in texts for m in TERM.findall((t or "").lower())}
    got = {r.doc_id: r.spans for r in personal_data(docs).collect()}
    assert got == dict(enumerate(want))
