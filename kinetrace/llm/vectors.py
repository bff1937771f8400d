"""Embedding columns: which rows can be used, and their values as numpy blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def usable(vector: str | Column) -> Column:
    """Whether a vector is there, has components, and all of them are finite numbers."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(v) > 0) & finite, F.lit(False))


def by_length(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix in double precision) for each length of the vectors of an Arrow list column."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(lengths)
    out = []
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        cells = flat if len(at) == len(lengths) else flat[((ends[at] - dim)[:, None] + np.arange(dim)).ravel()]
        out.append((at, cells.reshape(len(at), dim)))
    return out
