"""Whitening against a full eigendecomposition, with awkward rows."""

from __future__ import annotations

import numpy as np
import pytest

from telemill.llm.whitening import lanczos, op11_embedding_whitening, whiten

SCHEMA = "vec_id long, embedding array<float>, component int, label string"


def table(spark, vectors):
    rows = [(i, v, 7, "x") for i, v in vectors]  # a column named as one of the result's
    return spark.createDataFrame(rows, SCHEMA)


def expected(vectors, components=32):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    y = (n * x - sums) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return n, ((n * x - sums) ** 2).sum(axis=1), y @ axes / np.sqrt(values), values / (y**2).sum() * n


def test_equals_eigendecomposition(spark):
    random = np.random.default_rng(3)
    scales = np.linspace(3, 1, 12)
    vectors = random.standard_normal((300, 12)) * scales + 5
    got = whiten(table(spark, [(i, v.tolist()) for i, v in enumerate(vectors)]), components=5).toPandas()
    n, deviation, white, explained = expected(vectors, 5)
    got = got.sort_values(["vec_id", "component"])
    assert list(got["component"]) == [1, 2, 3, 4, 5] * n
    assert (got["n"] == n).all() and (got["identity_error"] < 1e-9).all()
    assert (got["deviation"].to_numpy()[::5] == deviation).all()
    mine = got["whitened"].to_numpy().reshape(n, 5)
    mine = mine * np.sign((mine * white).sum(axis=0))
    assert np.abs(mine - white).max() < 1e-9
    assert np.allclose(got["explained"].to_numpy()[:5], explained, rtol=1e-12)


def test_given_table(spark):
    got = op11_embedding_whitening(spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, white, explained = expected([r["embedding"] for r in rows])
    got = got.toPandas().sort_values(["vec_id", "component"])
    mine = got["whitened"].to_numpy().reshape(n, 32)
    assert np.abs(mine * np.sign((mine * white).sum(axis=0)) - white).max() < 1e-9
    assert (got["deviation"].to_numpy()[::32] == deviation).all()
    assert np.allclose(got["explained"].to_numpy()[:32], explained, rtol=1e-12)


def test_unusable_vectors_have_no_rows(spark):
    good = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (2, [2.0, 1.0]), (None, [4.0, 4.5])]
    nan, inf = float("nan"), float("inf")
    bad = [(9, v) for v in (None, [], [None, 1.0], [nan, 1.0], [inf, 1.0], [-inf, 1.0], [1e30, 1.0], [1.0], [1.0] * 3)]
    got = whiten(table(spark, good + bad)).toPandas()
    assert len(got) == 8 and (got["n"] == 4).all()  # two components, repeated and null ids kept
    assert got["vec_id"].isna().sum() == 2 and (got["vec_id"] == 2).sum() == 4
    assert got.groupby("component")["explained"].first().sum() == pytest.approx(1)


@pytest.mark.parametrize("vectors", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, None)]])
def test_nothing_to_whiten(spark, vectors):
    assert whiten(table(spark, vectors)).count() == 0


def test_directions_without_deviation_are_left_out(spark):
    vectors = [(i, [float(i % 7), float(i % 5), float(i % 7), 3.0]) for i in range(40)]
    got = whiten(table(spark, vectors)).toPandas()
    assert sorted(got["component"].unique()) == [1, 2]
    assert (got["identity_error"] < 1e-9).all()


def test_deviation_that_no_long_holds_is_null(spark):
    got = whiten(table(spark, [(1, [1e13]), (2, [0.0])])).toPandas()
    assert got["deviation"].isna().all() and np.allclose(got["whitened"].abs(), 1)


@pytest.mark.parametrize("values", [[5, 5, 5, 5], [4, 4, 2, 1], [9, 3, 3, 0], [3, 0, 0, 0]])
def test_repeated_and_missing_singular_values(values):
    random = np.random.default_rng(1)
    left, _ = np.linalg.qr(random.standard_normal((9, 4)))
    right, _ = np.linalg.qr(random.standard_normal((4, 4)))
    y = left @ np.diag(values) @ right.T

    def step(w, before):
        p = y @ w
        return p @ p, np.array([p @ (y @ b) for b in before]), y.T @ p

    got, vectors = lanczos(step, 4, 4, 4)
    true = [v for v in values if v]
    assert np.allclose(got, true) and np.allclose(vectors.T @ vectors, np.eye(len(true)))
    assert np.allclose(y.T @ (y @ vectors), vectors * np.square(true))


def test_stops_before_all_dimensions():
    y = np.diag([2.0**-i for i in range(40)])
    steps = []

    def step(w, before):
        steps.append(1)
        p = y @ w
        return p @ p, np.array([p @ (y @ b) for b in before]), y.T @ p

    got, _ = lanczos(step, 40, 40, 3)
    assert np.allclose(got, [1, 0.5, 0.25], rtol=1e-13) and len(steps) < 40
