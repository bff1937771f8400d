"""Whitening of embeddings by one covariance, merged from partitions.

Each partition works out the count, sums, mean and centred scatter of its rows;
two such summaries are merged by the pairwise formula of Chan in ``treeReduce``,
so the driver receives one matrix of the vectors' width, whose eigenvectors it
takes.  A second pass measures the covariance of the whitened rows in the same
way and so verifies that it is the identity; the last one writes the rows.

Components become integers, floor(1024 * c) + 100000, so counts, sums and
distances to the mean are exact.  Defined results: rows with a null vector or with null
or non-finite components, and empty vectors, take no part and have no row; among vectors of several
lengths those of the most frequent length take part (of equally frequent
ones the longest); rows with a null id and repeated rows count like others; components whose variance is
nothing but rounding have no rows, so a table with fewer than two different vectors gives none;
``deviation`` is null where it exceeds a long; other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import by_length, usable

STEP, SHIFT = 1024.0, 100_000
#: Components with a share of the variance below this are rounding.
LEAST_SHARE = 1e-12
#: Rows that are worked on together.
ROWS = 2048
SUMMARY = "dim int, n long, sums array<long>, mean array<double>, scatter array<double>"
#: (n, sums, mean, scatter) by vector length.
Moments = dict[int, tuple[int, np.ndarray, np.ndarray, np.ndarray]]


def whole(matrix: np.ndarray) -> np.ndarray:
    """Components as integers, in double precision, where they are exact."""
    return np.floor(STEP * matrix) + SHIFT


def moments(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Count, sums, mean and centred scatter of a block of rows."""
    sums = x.sum(axis=0)
    mean = sums / len(x)
    centred = x - mean
    return len(x), sums, mean, centred.T @ centred


def merge(a, b):
    """Chan's formula for two summaries of one length."""
    if a is None or b is None:
        return a or b
    n = a[0] + b[0]
    apart = b[2] - a[2]
    scatter = a[3] + b[3] + np.outer(apart, apart) * (a[0] * b[0] / n)
    return n, a[1] + b[1], a[2] + apart * (b[0] / n), scatter


def merge_all(a: Moments, b: Moments) -> Moments:
    return {dim: merge(a.get(dim), b.get(dim)) for dim in a.keys() | b.keys()}


def summaries(df: DataFrame, vector: str, project=None) -> Moments:
    """Moments of all rows by vector length: one summary a partition, merged in a tree.

    ``project`` turns a block of integers into what is summed up, as (length, block).
    """

    def run(batches):
        found: Moments = {}
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                for _, m in by_length(batch.column(0).slice(begin, ROWS)):
                    x = whole(m)
                    dim = x.shape[1]
                    if project is not None:
                        x = project(dim, x)
                    if x is not None:
                        found = merge_all(found, {dim: moments(x)})
        for dim, (n, sums, mean, scatter) in found.items():
            cells = [pa.array([v]) for v in (sums.tolist(), mean.tolist(), scatter.ravel().tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([n], pa.int64()), *cells], ["dim", "n", "sums", "mean", "scatter"])

    schema = SUMMARY.replace("sums array<long>", "sums array<double>")
    rows = df.select(vector).mapInArrow(run, schema).rdd
    parts = rows.map(lambda r: {r.dim: (r.n, np.array(r.sums), np.array(r.mean), np.array(r.scatter).reshape(len(r.mean), -1))})
    return parts.treeReduce(merge_all, depth=3) if not parts.isEmpty() else {}


class Whitening:
    """A fitted whitening: count, sums, eigenvalues and eigenvectors (as rows), by falling eigenvalue."""

    def __init__(self, n: int, sums: np.ndarray, scatter: np.ndarray, keep: int):
        self.n, self.sums = n, sums
        covariance = (scatter + scatter.T) / (2 * n)
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(values, kind="stable")[::-1]
        self.trace = float(np.trace(covariance))
        real = [k for k in order[:keep] if values[k] > LEAST_SHARE * self.trace]
        self.values, self.axes = values[real], vectors[:, real].T
        # Of the two directions, the one in which the largest entry is positive.
        largest = np.abs(self.axes).argmax(axis=1)
        self.axes = self.axes * np.sign(self.axes[np.arange(len(real)), largest])[:, None]
        self.dim = len(sums)

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of integer rows."""
        centred = (self.n * x - self.sums) / self.n
        return centred @ self.axes.T / np.sqrt(self.values)


def fit(df: DataFrame, vector: str = "embedding", keep: int = 8) -> Whitening | None:
    """The whitening of a table's usable rows, or None if it has none."""
    found = summaries(df.where(usable(vector)), vector)
    if not found:
        return None
    dim = max(found, key=lambda d: (found[d][0], d))
    n, sums, _, scatter = found[dim]
    return Whitening(n, sums, scatter, keep)


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    found = summaries(df.where(usable(vector)), vector, lambda dim, x: model.apply(x) if dim == model.dim else None)
    n, _, _, scatter = found[model.dim]
    return float(np.abs(scatter / n - np.eye(len(scatter))).max(initial=0.0))


def deviations(model: Whitening, x: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n*x - S)^2, exactly; null beyond a long."""
    n, sums = int(model.n), [int(s) for s in model.sums]
    apart = float(np.abs(n * x - model.sums).max(initial=0.0))
    if apart**2 * len(sums) < 2.0**62 and apart < 2.0**31 and n * float(np.abs(x).max(initial=0.0)) < 2.0**62:
        d = n * x.astype(np.int64) - np.array(sums, dtype=np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return [v if v < 2**63 else None for v in exact]


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", keep: int = 8) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and component."""
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(df, vector, keep)
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    error = identity_error(df, model, vector)
    parts, explained = len(model.values), model.values / model.trace

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                ids = batch.column(0).slice(begin, ROWS)
                for at, m in by_length(batch.column(1).slice(begin, ROWS)):
                    if m.shape[1] != model.dim:
                        continue
                    x = whole(m)
                    rows = len(x)
                    spread = lambda v: np.repeat(v, parts)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(spread(at))),
                            pa.array(np.tile(np.arange(1, parts + 1, dtype=np.int32), rows)),
                            pa.array(np.full(rows * parts, model.n, dtype=np.int64)),
                            pa.array([d for d in deviations(model, x) for _ in range(parts)], pa.int64()),
                            pa.array(model.apply(x).ravel()),
                            pa.array(np.tile(explained, rows)),
                            pa.array(np.full(rows * parts, error)),
                        ],
                        ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    return df.where(usable(vector)).select(id_col, vector).mapInArrow(run, schema)
