"""Whitening of embeddings: leading eigenvectors of their covariance by Chebyshev-filtered subspace iteration.

The vectors stay where they are: each step of the polynomial's recurrence is one pass in which every task adds up its part of
the product of the covariance with a narrow block. Block and product (dimensions x block) are all that reaches the driver,
whatever the number of vectors; QR, Rayleigh-Ritz and the decision to go on are made there. The filter grows the wanted end
of the spectrum against [0, the smallest Ritz value of the block], which holds what is not wanted. It ends when the residual
of every wanted pair is within TOLERANCE of the largest eigenvalue, or within DOUBLE of it and no longer falling.

An entry c becomes the integer x = floor(64 c) + 1000000, so sums are exact; n x - S is centred before anything is
multiplied. Left out: rows whose vector is null, holds nulls or entries that aren't finite (or of 2 ** 56 and more, which no
long could hold), and rows of another length than most (of equally many, the longer). Repeated rows count as often as they
are there. Components without variance (an eigenvalue of at most FLAT of the largest) have no rows, so neither equal vectors
nor a single one nor an empty table give any. A null vec_id stays null. A deviation that no long can hold is null. Other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

SCALE, SHIFT, LARGEST = 64, 1_000_000, float(1 << 56)
COMPONENTS, GUARD, DEGREE, ROUNDS = 32, 16, 16, 60
TOLERANCE, DOUBLE, FLAT = 1e-14, 1e-11, 1e-12
SEED = 12


@dataclass(frozen=True)
class Centre:
    """How many vectors, the sum of each dimension, and whether n x - S and the sum of its squares fit 64 bits."""

    n: int
    sums: tuple[int, ...]
    narrow: bool
    narrow_squares: bool

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        if self.narrow:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(np.float64)

    def squares(self, x: np.ndarray) -> pa.Array:
        z = self.deviations(x)
        if self.narrow_squares:
            return pa.array((z * z).sum(axis=1))
        exact = (int((row.astype(object) ** 2).sum()) for row in z)
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): the vectors that take part, as integers."""
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    cells = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & sound)
    usual = cells.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    cells = cells.filter(F.size("v") == (usual["d"] if usual else 0))
    return cells.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + F.lit(SHIFT)).alias("x"))


def centre_of(vectors: DataFrame) -> Centre:
    """Counts and exact sums over all vectors (vec_id, x)."""
    cell = F.col("col").cast("decimal(38,0)")
    found = vectors.select(F.posexplode("x")).groupBy("pos").agg(F.count("*").alias("n"), F.sum(cell).alias("s"), F.min("col").alias("low"), F.max("col").alias("high")).orderBy("pos").collect()
    n, largest = (found[0]["n"] if found else 0), max((max(abs(r["low"]), abs(r["high"])) for r in found), default=0)
    wide = max((n * (r["high"] - r["low"]) for r in found), default=0)
    return Centre(n, tuple(int(r["s"]) for r in found), n * largest < 1 << 61, n * largest < 1 << 61 and wide * wide * max(1, len(found)) < 1 << 62)


def matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def summed(vectors: DataFrame, part: Callable[[np.ndarray], np.ndarray], d: int, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all tasks of part(x), a matrix of this shape for a matrix of vectors."""
    rows, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, x in matrices(batches, d):
            total += part(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows, dtype=np.int32)), *(pa.array(total[:, j]) for j in range(width))], ["i", *(f"c{j}" for j in range(width))])

    made = vectors.select("x").mapInArrow(run, ", ".join(["i int", *(f"c{j} double" for j in range(width))]))
    out = np.zeros(shape)
    for r in made.groupBy("i").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(width))).collect():
        out[r["i"]] = r[1:]
    return out


def filtered(times: Callable[[np.ndarray], np.ndarray], block: np.ndarray, degree: int, cut: float, top: float) -> np.ndarray:
    """The block under the Chebyshev polynomial that stays within 1 on [0, cut], scaled to 1 at `top`."""
    half = cut / 2
    first = half / (top - half)
    sigma, before, now = first, block, (times(block) - half * block) * (first / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now, sigma = now, (times(now) - half * now) * (2 * after / half) - (sigma * after) * before, after
    return now


def leading(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, guard: int = GUARD, degree: int = DEGREE) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors (d x k) of the symmetric matrix that `times` multiplies by."""
    width = min(d, k + guard)
    block = np.eye(d) if width == d else np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, width)))[0]
    best = np.inf
    for _ in range(ROUNDS):
        product = times(block)
        inner = block.T @ product
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, product = block @ turn, product @ turn
        top = max(values[0], 0.0)
        off = np.linalg.norm(product - block * values, axis=0)[:k].max(initial=0.0)
        if off <= TOLERANCE * top or off <= DOUBLE * top and off > best / 2:
            return values[:k], block[:, :k]
        best = min(best, off)
        cut = min(max(values[-1], FLAT * top), top * (1 - 1e-6))
        block = np.linalg.qr(filtered(times, block, degree, cut, top))[0]
    raise RuntimeError(f"residual {off:g} after {ROUNDS} rounds")


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector that takes part and component."""
    cells = stash(integers(vectors, id_col, vector_col), "whiten-integers")
    kinds = f"vec_id {dict(cells.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    centre = centre_of(cells)
    n, d = centre.n, len(centre.sums)
    if not d:
        return cells.sparkSession.createDataFrame([], kinds)

    def times(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            y = centre.centred(x)
            return y.T @ (y @ block)

        return summed(cells, part, d, block.shape) / n

    trace = summed(cells, lambda x: np.array([[(centre.centred(x) ** 2).sum()]]), d, (1, 1))[0, 0] / n
    values, vectors_of = leading(times, d, min(components, d)) if trace > 0 else (np.zeros(0), np.zeros((d, 0)))
    alive = values > FLAT * max(values, default=0.0)
    values, basis = values[alive], vectors_of[:, alive] / np.sqrt(values[alive])
    k = len(values)
    if not k:
        return cells.sparkSession.createDataFrame([], kinds)

    def covariance(x: np.ndarray) -> np.ndarray:
        w = centre.centred(x) @ basis
        return w.T @ w

    error = float(np.abs(summed(cells, covariance, d, (k, k)) / n - np.eye(k)).max())
    explained = values / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in matrices(batches, d):
            m, made = len(x), centre.centred(x) @ basis
            row = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), centre.squares(x).take(row),
                pa.array(made.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return cells.mapInArrow(project, kinds)
