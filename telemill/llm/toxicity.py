"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are all words of the examples, with how often they occur. Beginnings and
numbers of words that labelled examples show to go with toxicity, the features,
are further terms that weigh more. IDF comes from all documents. Examples lie
in an inverted index in blocks, with the largest weight of each term in each
block: the sum of these bounds the cosine of all examples of a block, so blocks
that cannot hold a nearest one are not searched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.language import remainder
from telemill.llm.words import map_batches, plain, starts_of, whole_batches
from telemill.session import stored

#: Labelled texts of either class that the model is fitted on, at most, chosen by a hash of their id.
EXAMPLES = 2000
FEATURES = 1024
#: Chi-squared of a feature at least (one chance in a thousand), in this many toxic examples at least.
LEAST_CHI2, LEAST_TOXIC = 10.83, 3
#: A feature counts as so many times its IDF.
BOOST = 8
NEIGHBOURS = 15
#: Scores are calibrated on the examples in this many groups of equal size.
GROUPS = 20
CUT = 0.3
#: A term counts as frequent by its number in so many words of the text.
RATE_WORDS = 300
LEVELS = 3
REMEMBERED = 400_000
#: Examples of a block, and texts searched together.
BLOCK, TOGETHER = 128, 1024
#: A term of at least one in HEAVY rows of a table is kept in full there, and so many of them at most.
HEAVY, FULL = 8, 1024
#: Texts whose score a task remembers.
REMEMBERED_TEXTS = 20_000

_LETTERS = re.compile(r"[^\W\d_]{3,}")


def stems(word: str) -> list[str]:
    """The word and its beginnings of four to seven letters."""
    return [word, *[f"{word[:n]}-" for n in range(4, 8) if n <= len(word)]]


def _levels(count: int, words: int) -> int:
    """1, 2 or 3: how often a term occurs in a text, or in ``RATE_WORDS`` words of a longer one."""
    return max(1, min(LEVELS, round(count * RATE_WORDS / max(words, RATE_WORDS))))


def _example_terms(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Terms with their level, and in how many texts of each class they are."""
    found = (Counter(), Counter())
    for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
        words = Counter(_LETTERS.findall((text or "").lower()))
        total = sum(words.values())
        terms = Counter()
        for word, count in words.items():
            for stem in stems(word):
                terms[stem] += count
        for term, count in terms.items():
            for level in range(1, _levels(count, total) + 1):
                found[toxic][f"{level}{term}"] += 1
    terms = list(found[0].keys() | found[1].keys())
    return pa.RecordBatch.from_arrays(
        [pa.array(terms, pa.string()), *[pa.array([found[c][t] for t in terms], pa.int64()) for c in (0, 1)]],
        names=["term", "clean", "toxic"],
    )


def choose_features(examples: DataFrame) -> list[str]:
    """At most ``FEATURES`` terms that go with toxicity, by chi-squared, from ``text, toxic``."""
    size = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        return []
    terms = map_batches(examples, _example_terms, "term string, clean bigint, toxic bigint")
    terms = terms.groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    n = bad + good
    chi2 = F.expr(
        f"{n}D * pow(t * {good}D - c * {bad}D, 2) / ({bad}D * {good}D * (t + c) * ({n} - t - c + 0.5D))"
    )
    return [
        r["term"]
        for r in terms.where(f"t >= {LEAST_TOXIC} and t * {good}D > c * {bad}D")
        .select("term", chi2.alias("chi2"))
        .where(F.col("chi2") >= LEAST_CHI2)
        .orderBy(F.desc("chi2"), "term")
        .limit(FEATURES)
        .collect()
    ]


def _example_words(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Distinct words of the texts of a batch."""
    words = {w for text in batch["text"].to_pylist() for w in _LETTERS.findall((text or "").lower())}
    return pa.RecordBatch.from_arrays([pa.array(sorted(words), pa.string())], names=["word"])


class Vocabulary:
    """Numbers of the features, then of all words of the examples."""

    def __init__(self, features: list[str], words: list[str]):
        self.size = len(features) + len(words)
        self.features = len(features)
        self.words = {w: len(features) + i for i, w in enumerate(words)}
        self.levels: dict[str, dict[int, int]] = {}
        for i, term in enumerate(features):
            self.levels.setdefault(term[1:], {})[int(term[0])] = i
        self.known: dict[str, tuple[int, tuple[str, ...]] | None] = {}

    def terms(self, text: str | None) -> tuple[list[int], list[int]]:
        """Sorted terms of a text, and how often each occurs; words that no example has are none."""
        words = _LETTERS.findall((text or "").lower())
        stem_counts: Counter[str] = Counter()
        found, known = {}, self.known
        for word, count in Counter(words).items():
            hit = known.get(word, 0)
            if hit == 0:
                if len(known) > REMEMBERED:
                    known.clear()
                own, some = self.words.get(word, -1), tuple(s for s in stems(word) if s in self.levels)
                hit = known[word] = (own, some) if own >= 0 or some else None
            if hit is None:
                continue
            if hit[0] >= 0:
                found[hit[0]] = count
            for stem in hit[1]:
                stem_counts[stem] += count
        for stem, count in stem_counts.items():
            level = _levels(count, len(words))
            for at, i in self.levels[stem].items():
                if at <= level:
                    found[i] = 1
        terms = sorted(found)
        return terms, [found[t] for t in terms]


def _termed(shared):
    """Terms of each text."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [shared.value.terms(text) for text in batch["text"].to_pylist()]
        names = [n for n in batch.schema.names if n != "text"]
        columns = [pa.array([o[i] for o in out], pa.list_(pa.int32())) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*[batch[n] for n in names], *columns], names=[*names, "features", "counts"])

    return make


def _documents_with(size: int):
    """In how many texts of a task each term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        within = np.zeros(size, np.int64)
        for batch in batches:
            within += np.bincount(batch["features"].flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(within)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(within[some])], names=["term", "n"])

    return run


class Postings:
    """Some rows of sparse vectors by term: in full for terms of many rows, else as lists."""

    def __init__(self, terms: np.ndarray, rows: np.ndarray, values: np.ndarray, size: int, width: int):
        own, which = np.unique(terms, return_inverse=True)
        self.width = width
        self.slots = np.full(size, -1, np.int32)  # of each term, its place among those there are
        self.slots[own] = np.arange(len(own))
        often = np.bincount(which, minlength=len(own))
        first = np.argsort(-often, kind="stable")[:FULL]
        first = first[often[first] * HEAVY >= width]
        self.full = np.full(len(own), -1, np.int32)
        self.full[first] = np.arange(len(first))
        heavy = self.full[which] >= 0
        self.matrix = np.zeros((len(first), width))
        self.matrix[self.full[which[heavy]], rows[heavy]] = values[heavy]
        light = which[~heavy]
        order = np.argsort(light, kind="stable")
        self.rows, self.values = rows[~heavy][order].astype(np.int32), values[~heavy][order]
        self.counts = np.bincount(light, minlength=len(own)).astype(np.int32)
        self.starts = starts_of(self.counts).astype(np.int32)

    def products(self, query: np.ndarray, terms: np.ndarray, weights: np.ndarray, queries: int) -> np.ndarray:
        """Products of all rows with some queries, given as sparse entries."""
        slots = self.slots[terms]
        here = slots >= 0
        query, slots, weights = query[here], slots[here], weights[here]
        full = self.full[slots]
        heavy = full >= 0
        dense = np.zeros((queries, len(self.matrix)))
        dense[query[heavy], full[heavy]] = weights[heavy]
        out = dense @ self.matrix
        query, slots, weights = query[~heavy], slots[~heavy], weights[~heavy]
        counts = self.counts[slots]
        at = np.repeat(self.starts[slots] - starts_of(counts), counts) + np.arange(counts.sum())
        cells = np.repeat(query, counts) * self.width + self.rows[at]
        shares = np.repeat(weights, counts) * self.values[at]
        return out + np.bincount(cells, shares, queries * self.width).reshape(queries, self.width)


def _views(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column as pieces of its values, so that no number becomes a Python object."""
    if isinstance(column, pa.ChunkedArray):
        return [piece for chunk in column.chunks for piece in _views(chunk)]
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy()
    return [values[start:end] for start, end in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _flat(lists: list, kind: type) -> np.ndarray:
    return np.concatenate([np.asarray(some, kind) for some in lists]) if lists else np.zeros(0, kind)


class ExampleIndex:
    """Inverted index of unit vectors over the examples that have a term, in blocks of similar ones.

    ``rows`` are id, label (0 or 1) and terms of an example, and how often it
    has each (once if left out); ``weights`` the rows that an example stands for.
    Blocks are built by whoever searches first, so the driver, which does not, has none.
    """

    def __init__(self, rows: list[tuple], idf: np.ndarray, weights: tuple[float, float], block: int = BLOCK):
        # Terms in four bytes each, highest first, sort like the lists of them.
        rows = sorted((r for r in rows if len(r[2])), key=lambda r: (np.asarray(r[2], ">i4").tobytes(), r[1], str(r[0])))
        self.idf, self.weights, self.block = idf, weights, block
        self.ids = [r[0] for r in rows]
        self.labels = np.array([r[1] for r in rows], np.int64)
        sizes = np.array([len(r[2]) for r in rows], np.int64)
        self.terms = _flat([r[2] for r in rows], np.int32)
        self.often = _flat([r[3] if len(r) > 3 else [1] * len(r[2]) for r in rows], np.int32)
        self.ends = np.cumsum(sizes)
        self.searched = 0  # pairs of text and block of which all cosines were worked out
        self.bounds, self.parts = None, None

    def __getstate__(self) -> dict:
        """What travels to the tasks: the terms, of which each worker builds the blocks once."""
        return {**self.__dict__, "bounds": None, "parts": None}

    @property
    def features(self) -> list[np.ndarray]:
        return np.split(self.terms, self.ends[:-1]) if self.ids else []

    @property
    def counts(self) -> list[np.ndarray]:
        return np.split(self.often, self.ends[:-1]) if self.ids else []

    def _build(self) -> None:
        place, term, value = self.vectors(self.features, self.counts)
        idf, block = self.idf, self.block
        blocks = -(-len(self.ids) // block)
        within = place // block
        # The largest weight of each term in each block.
        cell, where = np.unique(term.astype(np.int64) * max(blocks, 1) + within, return_inverse=True)
        largest = np.zeros(len(cell))
        np.maximum.at(largest, where, value)
        self.bounds = Postings(cell // max(blocks, 1), cell % max(blocks, 1), largest, len(idf), blocks)
        self.parts = []
        for b in range(blocks):
            own = within == b
            width = min(block, len(self.ids) - b * block)
            self.parts.append(Postings(term[own], place[own] - b * block, value[own], len(idf), width))

    def vectors(self, features: list, counts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors of texts as entries: text, term, weight."""
        sizes = np.array([len(f) for f in features], np.int64)
        text = np.repeat(np.arange(len(features)), sizes)
        term, often = _flat(features, np.int64), _flat(counts, np.float64)
        weight = self.idf[term] * (1 + np.log(often))
        length = np.sqrt(np.bincount(text, weight**2, len(features)))
        return text, term, weight / length[text]

    def nearest(
        self, features: list, counts: list, count: int, without: list[int] | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """The ``count`` nearest examples of each text as cosines and places, nearest first; equal ones by place.

        Cosines are rounded to twelve places. Where fewer examples share a term
        with a text, the rest have cosine 0. ``without`` names one example to
        leave out for each text.
        """
        some = len(features)
        best, at = np.zeros((some, count)), np.full((some, count), len(self.ids))
        if not self.ids or not some:
            return best, at
        if self.parts is None:
            self._build()
        text, term, weight = self.vectors(features, counts)
        # Rounding may put a cosine above its bound by less than this.
        bounds = self.bounds.products(text, term, weight, some) + 1e-9
        without = np.full(some, -1) if without is None else np.asarray(without)
        starts = np.append(np.searchsorted(text, np.arange(some)), len(text))
        turns = np.argsort(-bounds, axis=1, kind="stable")
        for turn in range(len(self.parts)):
            # The next best block of each text that could still hold a nearer example.
            block = turns[:, turn]
            bound = bounds[np.arange(some), block]
            open_ = np.flatnonzero((bound > 1e-9) & (bound >= best[:, -1]))
            if not len(open_):
                break
            self.searched += len(open_)
            order = open_[np.argsort(block[open_], kind="stable")]
            for rows in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                b = int(block[rows[0]])
                sizes = starts[rows + 1] - starts[rows]
                entries = np.repeat(starts[rows] - starts_of(sizes), sizes) + np.arange(sizes.sum())
                local = np.repeat(np.arange(len(rows)), sizes)
                scores = self.parts[b].products(local, term[entries], weight[entries], len(rows)).round(12)
                places = np.arange(b * self.block, b * self.block + scores.shape[1])
                scores[places[None, :] == without[rows][:, None]] = 0.0
                every = np.concatenate((best[rows], scores), axis=1)
                spots = np.concatenate((at[rows], np.broadcast_to(places, scores.shape)), axis=1)
                spots = np.where(every > 0, spots, len(self.ids))
                first = np.lexsort((spots, -every), axis=1)[:, :count]
                best[rows] = np.take_along_axis(every, first, 1)
                at[rows] = np.take_along_axis(spots, first, 1)
        return best, at

    def votes(self, cosines: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Share of toxicity among the nearest of each text, by their cosine and the rows they stand for; NaN for none."""
        labels = np.append(self.labels, 0)[places]
        # The inverse of a distance that is never zero.
        share = np.where(cosines > 0, np.array(self.weights)[labels] / (1.05 - cosines), 0.0)
        with np.errstate(invalid="ignore"):
            return (share * labels).sum(axis=1) / share.sum(axis=1)


def calibrate(votes: list[float], labels: list[int], weights: list[float]) -> tuple[list[float], list[float]]:
    """Points of a rising line from votes to the share of toxic rows (pooled neighbours of groups)."""
    order = np.argsort(votes, kind="stable")
    pools = []
    for part in np.array_split(order, min(GROUPS, len(order))):
        weight = sum(weights[i] for i in part)
        toxic = sum(weights[i] * labels[i] for i in part)
        middle = sum(weights[i] * votes[i] for i in part)
        pools.append([middle, toxic, weight])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return [p[0] / p[2] for p in pools], [p[1] / p[2] for p in pools]


def _votes(shared):
    """Votes of the examples of a batch, each without itself."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        index = shared.value
        place = {doc_id: at for at, doc_id in enumerate(index.ids)}
        some = [(place[i], f, c) for i, f, c in zip(batch["doc_id"].to_pylist(), *map(_views, (batch["features"], batch["counts"]))) if len(f)]
        votes = []
        for start in range(0, len(some), TOGETHER // 4):
            own, features, counts = zip(*some[start : start + TOGETHER // 4])
            votes += index.votes(*index.nearest(features, counts, NEIGHBOURS, own)).tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array([at for at, _, _ in some], pa.int32()), pa.array(votes, pa.float64())], names=["place", "vote"]
        )

    return make


def share_without(rows: list[tuple], weights: tuple[float, float]) -> float:
    """Share of toxic rows among the examples without a term, for texts that share none with an example."""
    empty = [0.5 * weights[r[1]] if not len(r[2]) else 0.0 for r in rows]
    toxic = sum(w for w, r in zip(empty, rows) if r[1])
    return toxic / sum(empty) if sum(empty) else 0.0


def fitted_line(index: ExampleIndex, votes: list[float], without: float) -> tuple[list[float], list[float]]:
    """Calibration by the votes of all examples, in order of their places; NaN for none."""
    known = [(v, int(label)) for v, label in zip(votes, index.labels) if v == v]
    if not known:
        return [0.0], [without]
    votes, labels = zip(*known)
    return calibrate(list(votes), list(labels), [index.weights[label] for label in labels])


class Model:
    """Index, calibration, and the score of texts that share no term with an example."""

    def __init__(self, index: ExampleIndex, line: tuple[list[float], list[float]], without: float):
        self.index, self.line, self.without = index, line, without

    def score(self, features: list, counts: list) -> list[tuple[float, list[int], list[float]]]:
        """Calibrated score of each text, and the three nearest examples with their cosines."""
        out = [(self.without, [], [])] * len(features)
        some = [i for i, f in enumerate(features) if len(f)]
        for start in range(0, len(some), TOGETHER):
            part = some[start : start + TOGETHER]
            cosines, places = self.index.nearest([features[i] for i in part], [counts[i] for i in part], NEIGHBOURS)
            scores = np.interp(self.index.votes(cosines, places), *self.line)
            for i, score, cosine, place in zip(part, scores.tolist(), cosines[:, :3].tolist(), places[:, :3].tolist()):
                if cosine[0] > 0:
                    near = [(self.index.ids[p], c) for p, c in zip(place, cosine) if c > 0]
                    out[i] = (score, [n[0] for n in near], [n[1] for n in near])
        return out


def _scored(shared, line: tuple[list[float], list[float]], without: float):
    known: dict[tuple[int, int], tuple] = {}

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        if len(known) > REMEMBERED_TEXTS:
            known.clear()
        keys = list(zip(batch["k1"].to_pylist(), batch["k2"].to_pylist()))
        new = {key: row for row, key in enumerate(keys) if key not in known}
        keys_of, places = list(new), list(new.values())
        model, rows = Model(shared.value, line, without), [_views(batch[n]) for n in ("features", "counts")]
        for start in range(0, len(keys_of), TOGETHER):
            part = [[row[place] for place in places[start : start + TOGETHER]] for row in rows]
            known.update(zip(keys_of[start : start + TOGETHER], model.score(*part)))
        out = [known[key] for key in keys]
        columns = [
            pa.array([o[0] for o in out], pa.float64()),
            pa.array([o[1] for o in out], pa.list_(pa.int64())),
            pa.array([o[2] for o in out], pa.list_(pa.float64())),
        ]
        names = ["doc_id", "k1", "k2"]
        return pa.RecordBatch.from_arrays(
            [*[batch[n] for n in names], *columns], names=[*names, "score", "evidence", "cosines"]
        )

    return make


def _fitted(example_terms: DataFrame, idf: np.ndarray, classes: dict[int, int]) -> tuple[ExampleIndex, float]:
    """The index of all examples, and the score of texts that share no term with one."""
    rows = example_terms.toArrow()
    views = [_views(rows[name]) for name in ("features", "counts")]
    rows = list(zip(rows["doc_id"].to_pylist(), rows["toxic"].to_pylist(), *views))
    size = Counter(r[1] for r in rows)
    weights = tuple(classes.get(c, 0) / max(size[c], 1) for c in (0, 1))
    return ExampleIndex(rows, idf, weights), share_without(rows, weights)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """Score of each text: ``doc_id, k1, k2, score, predicted, evidence, cosines``, a row for each row.

    ``k1, k2`` name the text by its content. At most ``EXAMPLES`` labelled texts
    of each class, of rows for which ``learn`` holds (over ``doc_id``), are the
    examples, all of whose words are terms, with IDF counted over all
    documents; words that no example has are no terms. ``cosines`` are those of
    the nearest examples in ``evidence``. A score depends on nothing but the
    text. Of the texts of an example's id, the smallest is taken. Texts that share no term with an
    example, null and empty ones among them, have no neighbour and get the
    share of toxic rows among examples without a word; without labels of
    both classes every score is that of the examples there are, or 0. Labels
    other than 0 and 1, and null ids, are not learned from; rows may repeat;
    other columns are not looked at.
    """
    spark = docs.sparkSession
    docs = (
        plain(docs, doc_id=id_col, text=text_col)
        .withColumn("doc_id", F.col("doc_id").cast("bigint"))
        .withColumn("text", F.coalesce("text", F.lit("")))
        .withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), "text")})
    )
    labels = plain(labels, doc_id=id_col, toxic=label_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    labels = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    labels = labels.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    labels = labels.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    labels = stored(labels, "labels")
    classes = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = labels.where("toxic = 1").orderBy(*order).limit(EXAMPLES)
    chosen = chosen.union(labels.where("toxic = 0").orderBy(*order).limit(EXAMPLES))
    chosen = F.broadcast(stored(chosen, "chosen"))  # 2 * EXAMPLES rows at most
    examples = docs.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    examples = stored(examples, "examples")
    features = choose_features(examples.select("text", "toxic"))

    words = map_batches(examples.select("text"), _example_words, "word string").distinct()
    vocabulary = Vocabulary(features, sorted(words.toArrow()["word"].to_pylist()))
    shared = spark.sparkContext.broadcast(vocabulary)
    size, chosen_features = vocabulary.size, vocabulary.features
    del vocabulary, features
    termed = "features array<int>, counts array<int>"
    featured = stored(map_batches(docs, _termed(shared), f"doc_id bigint, k1 bigint, k2 bigint, {termed}"), "features")
    total = featured.count()
    within = np.zeros(size)
    counted = featured.select("features").mapInArrow(_documents_with(size), "term bigint, n bigint")
    counted = counted.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    within[counted["term"].to_numpy()] = counted["n"].to_numpy()
    del counted
    idf = 1 + np.log((1 + total) / (1 + within))
    idf[:chosen_features] *= BOOST
    example_terms = map_batches(
        examples.select("doc_id", "toxic", "text"), _termed(shared), f"doc_id bigint, toxic int, {termed}"
    )
    example_terms = stored(example_terms, "example-terms")
    index, without = _fitted(example_terms, idf, classes)
    shared = spark.sparkContext.broadcast(index)
    # The driver keeps what it needs of the index and searches nothing: examples are scored by tasks like texts.
    votes = whole_batches(example_terms.drop("toxic"), _votes(shared), "place int, vote double").toArrow()
    votes = dict(zip(votes["place"].to_pylist(), votes["vote"].to_pylist()))
    line = fitted_line(index, [votes[at] for at in range(len(index.ids))], without)
    del index
    scored = whole_batches(
        featured,
        _scored(shared, line, without),
        "doc_id bigint, k1 bigint, k2 bigint, score double, evidence array<bigint>, cosines array<double>",
    )
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def not_held_out() -> Column:
    return F.coalesce(remainder("doc_id", 4) != 2, F.lit(False))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels whose remainder modulo 4 is not 2."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return score_toxicity(docs, labels, not_held_out()).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted", "evidence", "cosines"
    )
