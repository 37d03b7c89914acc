"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

With Y the centred rows, the recurrence builds orthonormal v (a number per
dimension) and u (a number per row) with Y V = U B and B upper bidiagonal; the
singular values and right vectors of the small B give deviations and
components. A step is one pass over the rows: each task works out its part of
p = Yw and adds up its share of Yᵀp and of the products of p with all earlier
u. Since every u lies in the span of Y, u_j = Y w_j, only the short w are kept,
so that no vector with a number per row is ever stored or moved. Both bases
are orthogonalised against all their earlier members in each step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.words import plain
from telemill.session import stored

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000  # x = floor(SCALE * c) + SHIFT
LARGEST = float(1 << 46)  # |c| up to which SCALE * c is exact in a long
RESIDUAL = 1e-14  # of the largest singular value: a component counts as found
NOTHING = 1e-12  # of the largest singular value: directions below have no deviation
PARTS = 64  # partial sums that reach the driver at once


@dataclass
class Whitening:
    """What was fitted: rows, sums, components by falling eigenvalue, and how far off the result is."""

    n: int
    sums: np.ndarray  # of x, a long per dimension
    components: np.ndarray  # unit vectors in columns
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float


def lattice(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x``: the vectors on the integer lattice, without those that cannot be used.

    A vector goes if it is null or empty, holds null, NaN, infinite or larger
    entries than 2**46, or has not the length that most of the rest have (the
    larger length in a tie).
    """
    rows = plain(table, vec_id=id_col, vector=vector_col)
    rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    # NaN counts as larger than any number.
    fit = F.forall("vector", lambda c: c.isNotNull() & (F.abs(c) <= LARGEST))
    rows = rows.where(fit & (F.size("vector") > 0))
    length = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    rows = rows.where(F.size("vector") == (length["length"] if length else 0))
    return rows.select("vec_id", F.transform("vector", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of rows of :func:`lattice`, read once a step; None if no direction has a deviation.

    The recurrence ends once the largest ``components`` have converged, at the
    latest after as many steps as there are dimensions.
    """
    first = rows.first()
    if first is None:
        return None
    size, many = len(first["x"]), rows.rdd.getNumPartitions() > PARTS
    counted = summed(rows, many, lambda x: np.append(x.sum(axis=0), len(x)), np.zeros(size + 1, np.int64))
    n, sums = int(counted[-1]), counted[:-1]

    def step(w: np.ndarray, before: list[np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
        """Of p = Yw: its square, its products with the earlier u, and Yᵀp."""
        both, j = np.column_stack([w, *before]), len(before)

        def part(x: np.ndarray) -> np.ndarray:
            y = centred(x, n, sums)
            products = y @ both
            p = products[:, 0]
            return np.concatenate((p @ products, p @ y))

        found = summed(rows, many, part, np.zeros(1 + j + size))
        return float(found[0]), found[1 : 1 + j], found[1 + j :]

    deviations, vectors = lanczos(step, size, min(size, n), components)
    if not len(deviations):
        return None
    eigenvalues = deviations**2 / n

    def checked(x: np.ndarray) -> np.ndarray:
        y = centred(x, n, sums)
        white = y @ (vectors / np.sqrt(eigenvalues))
        return np.concatenate(((white.T @ white).ravel(), white.sum(axis=0), [(y**2).sum()]))

    k = len(eigenvalues)
    found = summed(rows, many, checked, np.zeros(k * k + k + 1))
    means = found[k * k : -1] / n  # nought but for rounding, as the rows are centred
    covariance = found[: k * k].reshape(k, k) / n - np.outer(means, means)
    error = float(np.abs(covariance - np.eye(k)).max())
    return Whitening(n, sums, vectors, eigenvalues, eigenvalues / (found[-1] / n), error)


def lanczos(
    step: Callable, size: int, most: int, components: int
) -> tuple[np.ndarray, np.ndarray]:
    """The largest singular values of Y, falling, and their right vectors in columns.

    ``step(w, W)`` gives (p·p, Uᵀp, Yᵀp) for p = Yw and U = YW. Where the
    recurrence ends early (a repeated singular value, or no direction left), it
    goes on from a new vector orthogonal to those before, to the last dimension.
    """
    random = np.random.default_rng(0)
    basis, short, images = [], [], []  # v_j, w_j, Yᵀu_j
    upper = np.zeros((most, most))
    w, largest, restarted = None, 0.0, False
    for j in range(most):
        if w is None:
            v = orthogonal(random.standard_normal(size), basis)
            basis.append(v / np.linalg.norm(v))
            w = basis[-1]
        square, across, image = step(w, short)
        for c, older, its in zip(across, short, images):
            w, image = w - c * older, image - c * its
        alpha = float(np.sqrt(max(square - across @ across, 0.0)))
        largest = max(largest, alpha)
        if alpha <= NOTHING * largest:  # nothing new in this direction: a row of noughts in B
            short.append(np.zeros(size))
            images.append(np.zeros(size))
            w, restarted = None, True
            continue
        upper[j, j] = alpha
        short.append(w / alpha)
        images.append(image / alpha)
        if j + 1 == most:
            break
        rest = orthogonal(images[-1] - alpha * basis[-1], basis)
        beta = float(np.linalg.norm(rest))
        if beta <= NOTHING * largest:
            w, restarted = None, True
            continue
        if j + 1 >= components and not restarted:
            left, values, _ = np.linalg.svd(upper[: j + 1, : j + 1])
            if beta * np.abs(left[-1, :components]).max() <= RESIDUAL * values[0]:
                break
        upper[j, j + 1] = beta
        basis.append(rest / beta)
        w = basis[-1] - beta * short[-1]
    used = len(basis)
    _, values, right = np.linalg.svd(upper[:used, :used])
    values, vectors = values[:components], np.column_stack(basis) @ right[:components].T
    kept = values > NOTHING * max(values[0], np.finfo(float).tiny)
    vectors = vectors[:, kept]
    # One sign for all rows: the entry furthest from nought is positive.
    ends = np.abs(vectors).argmax(axis=0)
    return values[kept], vectors * np.sign(vectors[ends, np.arange(vectors.shape[1])])


def orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """What is left of a vector beside a basis, taken off twice against rounding."""
    if basis:
        q = np.column_stack(basis)
        for _ in range(2):
            v = v - q @ (q.T @ v)
    return v


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n; the numerator is exact."""
    return (n * x - sums) / n


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch["x"].flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def summed(
    rows: DataFrame, many: bool, part: Callable[[np.ndarray], np.ndarray], start: np.ndarray
) -> np.ndarray:
    """The sum of ``part`` over all batches of rows: one array a task, of ``many`` tasks added up in PARTS."""
    whole = start.dtype.kind == "i"
    kind = pa.list_(pa.int64() if whole else pa.float64())
    schema = f"part array<{'bigint' if whole else 'double'}>"

    def add(batches: Iterator[pa.RecordBatch], make: Callable) -> Iterator[pa.RecordBatch]:
        total = start.copy()
        for batch in batches:
            if batch.num_rows:
                total += make(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total], kind)], names=["part"])

    parts = rows.mapInArrow(lambda batches: add(batches, lambda b: part(matrix(b))), schema)
    if many:
        again = lambda b: b["part"].flatten().to_numpy().reshape(b.num_rows, -1).sum(axis=0)
        parts = parts.repartition(PARTS).mapInArrow(lambda batches: add(batches, again), schema)
    return np.sum([row["part"] for row in parts.collect()] or [start], axis=0)


def transform(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for rows of :func:`lattice`.

    ``deviation`` is exact where it fits a long, else null.
    """
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = (
        f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, "
        "explained double, identity_error double"
    )
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model is None:
            return
        k = len(model.eigenvalues)
        scaled = model.components / np.sqrt(model.eigenvalues)
        for batch in batches:
            x, m = matrix(batch), batch.num_rows
            apart = model.n * x - model.sums
            # The integer sum is right modulo 2**64, so right where the true one fits.
            exact, about = (apart * apart).sum(axis=1), (apart.astype(float) ** 2).sum(axis=1)
            over = np.repeat(about >= 2.0**63 * (1 - 1e-9), k)
            columns = [
                batch["vec_id"].take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n)),
                pa.array(np.repeat(exact, k), mask=over),
                pa.array((centred(x, model.n, model.sums) @ scaled).ravel()),
                pa.array(np.tile(model.explained, m)),
                pa.array(np.full(m * k, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)


def whiten(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """Each usable vector on each component, a row a pair, numbered from 1 by falling eigenvalue.

    Vectors that :func:`lattice` leaves out have no rows; null and repeated ids
    stay as they are, and equal vectors count as often as they occur. Fewer
    components come out where fewer directions have a deviation: none for an
    empty table, one row, or equal rows. Other columns are not looked at. The
    lattice is written to the shared folder once, and read again in each step.
    """
    rows = stored(lattice(table, id_col, vector_col), "lattice")
    return transform(rows, fit(rows, components))


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings, whitened on 32 components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
