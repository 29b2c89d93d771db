"""Operator 13: whitening of embeddings by merging singular value decompositions.

Every task centres its vectors batch by batch and keeps what describes them without
loss: their number, their mean, and all singular values and right vectors of the
centred matrix. Two such summaries merge by stacking both scaled bases with one more
row, the scaled difference of the means, and decomposing that; nothing is truncated.
Summaries of tasks merge in a tree of small groups, so no task reads more than a
few. The last one holds the eigenvectors and eigenvalues of the covariance.

Vectors are first put on a grid of whole numbers and each different one is fitted
once, so that copies have no weight and sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

#: Steps of the grid to a unit, its offset, components returned.
GRID, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Summaries that one merging task reads at most.
FAN = 8
#: Singular values under this share of the largest are rounding, not a direction.
NEGLIGIBLE = 1e-10
_SUMMARY = "dim int, n bigint, sums array<bigint>, mean array<double>, scale array<double>, basis array<double>"


@dataclass
class Summary:
    """``n`` vectors: exact sums of whole numbers, mean, singular values and right vectors (rows) of the centred matrix."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scale: np.ndarray
    basis: np.ndarray

    @property
    def variances(self) -> np.ndarray:
        """Eigenvalues of the covariance, falling."""
        return self.scale**2 / max(self.n, 1)


def summary_of(rows: np.ndarray, sums: list[int] | None = None) -> Summary:
    """Summary of the rows of a matrix."""
    mean = rows.mean(axis=0)
    return Summary(len(rows), sums if sums is not None else [0] * rows.shape[1], mean, *_decomposed(rows - mean))


def _decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All singular values and right vectors; a matrix of fewer rows than columns is filled up by zeros, so that every dimension stays."""
    if len(rows) < rows.shape[1]:
        rows = np.vstack([rows, np.zeros((rows.shape[1] - len(rows), rows.shape[1]))])
    _, scale, basis = np.linalg.svd(rows, full_matrices=False)
    return scale, basis


def merged(a: Summary | None, b: Summary) -> Summary:
    """The summary of both lists of vectors together."""
    if a is None or not a.n:
        return b
    if not b.n:
        return a
    n = a.n + b.n
    apart = b.mean - a.mean
    stacked = np.vstack([a.scale[:, None] * a.basis, b.scale[:, None] * b.basis, np.sqrt(a.n / n * b.n) * apart])
    return Summary(n, [x + y for x, y in zip(a.sums, b.sums, strict=True)], a.mean + apart * (b.n / n), *_decomposed(stacked))


def finite(vector: Column) -> Column:
    """True for a vector that isn't null and holds neither null nor non-finite entries; zeros are fine."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def gridded(vector: Column) -> Column:
    """Whole numbers ``floor(64 * c) + 1000000`` of a vector's entries; those beyond 2**40 in size are held there."""
    bound = float(1 << 40)
    held = lambda c: F.least(F.greatest(c.cast("double"), F.lit(-bound)), F.lit(bound))
    return F.transform(vector, lambda c: F.floor(held(c) * GRID).cast("bigint") + OFFSET)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of whole numbers, for each length of vector in an Arrow column; empty vectors are passed over."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    for d in np.unique(lengths):
        if d:
            rows = np.flatnonzero(lengths == d)
            yield rows, flat[begins[rows][:, None] + np.arange(d)]


def _rows(found: dict[int, Summary]) -> pa.RecordBatch:
    every = list(found.items())
    arrays = [
        pa.array([d for d, _ in every], pa.int32()),
        pa.array([s.n for _, s in every], pa.int64()),
        pa.array([s.sums for _, s in every], pa.list_(pa.int64())),
        *(pa.array([np.ravel(getattr(s, x)).tolist() for _, s in every], pa.list_(pa.float64())) for x in ("mean", "scale", "basis")),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["dim", "n", "sums", "mean", "scale", "basis"])


def _read(row: dict) -> Summary:
    mean = np.array(row["mean"])
    return Summary(row["n"], list(row["sums"]), mean, np.array(row["scale"]), np.array(row["basis"]).reshape(len(mean), len(mean)))


def summarise(vectors: DataFrame, column: str, maps: dict[int, tuple[np.ndarray, np.ndarray]] | None = None) -> dict[int, Summary]:
    """The summary of all whole-number vectors of each length, by a tree of merges on Spark.

    With ``maps`` (centre and matrix by length) it is the summary of the mapped
    vectors. The driver gets one row a length of vector: its size depends on the
    dimensions alone.
    """
    small_batches(vectors.sparkSession)

    def leaves(batches):
        found: dict[int, Summary] = {}
        for batch in batches:
            for _, matrix in _by_length(batch.column(0)):
                d = matrix.shape[1]
                values, sums = (matrix - OFFSET).astype(np.float64), None
                if maps is None:
                    sums = [int(x) for x in matrix.sum(axis=0)]
                else:
                    values = (values - maps[d][0]) @ maps[d][1]
                if values.shape[1]:
                    found[d] = merged(found.get(d), summary_of(values, sums))
        yield _rows(found)

    def inner(batches):
        found: dict[int, Summary] = {}
        for batch in batches:
            for row in batch.to_pylist():
                found[row["dim"]] = merged(found.get(row["dim"]), _read(row))
        yield _rows(found)

    level = written(vectors.select(column).mapInArrow(leaves, _SUMMARY))
    parts = level.count()
    while parts > 1:
        parts = -(-parts // FAN)
        level = written(level.repartition(parts).mapInArrow(inner, _SUMMARY))
    last: dict[int, Summary] = {}
    for row in level.collect():
        last[row["dim"]] = merged(last.get(row["dim"]), _read(row.asDict()))
    return last


@dataclass
class Whitening:
    """A fitted whitening of vectors of one length: centre and matrix, both for ``x - OFFSET``, and what they explain."""

    n: int
    sums: list[int]
    centre: np.ndarray
    matrix: np.ndarray
    explained: list[float]


def _whitening(s: Summary, components: int) -> Whitening:
    centre = np.array([(total - s.n * OFFSET) / s.n for total in s.sums])
    kept = min(components, int((s.scale > NEGLIGIBLE * max(s.scale[0], 1e-300)).sum()))
    basis, e = s.basis[:kept], s.variances
    signs = np.sign(basis[np.arange(kept), np.abs(basis).argmax(axis=1)]) if kept else np.ones(0)
    return Whitening(s.n, s.sums, centre, (basis * signs[:, None]).T / np.sqrt(e[:kept]), [float(x) for x in e[:kept] / e.sum()] if kept else [])


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> tuple[dict[int, Whitening], float]:
    """The whitening for each length of vector, and the largest entry by which the whitened covariance misses the identity.

    Each different grid vector counts once. Components whose variance is zero (as
    in fewer vectors than dimensions) can't be whitened and are left out, so that
    copies of a single vector have none. No vectors give no whitening.
    """
    different = written(df.filter(finite(F.col(f"`{vector}`"))).select(gridded(F.col(f"`{vector}`")).alias("x")).distinct())
    models = {d: _whitening(s, components) for d, s in summarise(different, "x").items()}
    again = summarise(different, "x", {d: (m.centre, m.matrix) for d, m in models.items()}) if models else {}
    errors = [np.abs((s.basis.T * s.variances) @ s.basis - np.eye(len(s.basis))).max() for s in again.values()]
    return models, float(max(errors, default=0.0))


def transform(df: DataFrame, models: dict[int, Whitening], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, n, deviation, whitened, explained`` (the last two arrays by component) of every row that takes part.

    Rows whose vector is null, or holds null or non-finite entries, or is of a
    length that wasn't fitted, have no result. ``deviation`` is the exact sum of
    ``(n * x - S)**2``; beyond 63 bits it is null. Null ids, repeated ids and equal
    vectors are rows like any other; other columns don't matter.
    """
    small_batches(df.sparkSession)
    rows = df.filter(finite(F.col(f"`{vector}`"))).select(F.col(f"`{key}`").cast("bigint").alias("id"), gridded(F.col(f"`{vector}`")).alias("x"))

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for at, matrix in _by_length(batch.column(1)):
                m = models.get(matrix.shape[1])
                if m is None:
                    continue
                white = (matrix - OFFSET - m.centre) @ m.matrix
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)), pa.array(np.full(len(at), m.n)), pa.array(_deviation(matrix, m), pa.int64()), lists, pa.array([m.explained] * len(at), pa.list_(pa.float64()))],
                    names=["id", "n", "deviation", "whitened", "explained"],
                )

    return rows.mapInArrow(run, "id bigint, n bigint, deviation bigint, whitened array<double>, explained array<double>")


def _deviation(matrix: np.ndarray, m: Whitening) -> list[int | None]:
    """Sums of ``(n * x - S)**2`` in whole numbers; Python's own where 64 bits could overflow."""
    most = float(np.abs((matrix - OFFSET) - m.centre).max(initial=0)) * m.n + m.n
    if matrix.shape[1] * most**2 < 2**62 and m.n * float(np.abs(matrix).max(initial=0)) < 2**62 and max(map(abs, m.sums)) < 2**62:
        return ((m.n * matrix - np.array(m.sums)) ** 2).sum(axis=1).tolist()
    exact = ((m.n * matrix.astype(object) - np.array(m.sums, dtype=object)) ** 2).sum(axis=1)
    return [x if x < 1 << 63 else None for x in exact]


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each row that takes part and each component, numbered from 1: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    models, error = fit(df, vector, components)
    rows = transform(df, models, key, vector)
    one = rows.select("id", "n", "deviation", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return one.select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
        F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), F.lit(error).alias("identity_error"),
    )
