"""Reconstruction by principal components, one model for each fold.

Second moments are summed up once per sequence; a fold's are the total less those
of the sequence it leaves out, so no row is read twice for the folds.  Only a
matrix of the channels' width goes to numpy, a row per fold, in tasks; rows are joined
with their fold's model, and a task projects a batch of them at a time.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contracts import SEQUENCE

#: Components with more than this variance are kept; every channel has a variance of 1.
LEAST_VARIANCE = 1.0


def _pairs(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for k, a in enumerate(columns) for b in columns[k:]]


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(sequence, n, sums, products): what a mean and a covariance are made of, added up per sequence."""
    sums = F.array(*(F.sum(c) for c in columns))
    products = F.array(*(F.sum(F.col(a) * F.col(b)) for a, b in _pairs(columns)))
    return df.groupBy(SEQUENCE).agg(F.count(F.lit(1)).alias("n"), sums.alias("sums"), products.alias("products"))


def total(moments: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the sum of all moments."""
    width, pairs = len(columns), len(_pairs(columns))
    add = lambda name, k: F.array(*(F.sum(F.col(name)[i]) for i in range(k)))
    return moments.agg(F.sum("n").alias("n"), add("sums", width).alias("sums"), add("products", pairs).alias("products"))


def all_but_own(moments: DataFrame, columns: list[str]) -> DataFrame:
    """For each sequence the moments of all others."""
    every = total(moments, columns).toDF("all_n", "all_sums", "all_products")
    less = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    return moments.join(F.broadcast(every)).select(SEQUENCE, (F.col("all_n") - F.col("n")).alias("n"), less("all_sums", "sums").alias("sums"), less("all_products", "products").alias("products"))


def fit(moments: DataFrame, columns: list[str], least: float = LEAST_VARIANCE) -> DataFrame:
    """(sequence, mean, scale, projector, kept, explained) of each row of moments.

    Channels are brought to mean 0 and variance 1; the projector goes to the directions with a
    variance above ``least`` and back.  A channel that does not vary has a scale of 1; a row without
    others to learn from has no model.
    """
    width, at = len(columns), np.triu_indices(len(columns))

    def run(frames):
        for pdf in frames:
            out = []
            for name, n, sums, products in zip(pdf[SEQUENCE], pdf["n"], pdf["sums"], pdf["products"], strict=True):
                if n <= 0:
                    continue
                mean = np.asarray(sums, float) / n
                second = np.zeros((width, width))
                second[at] = np.asarray(products, float) / n
                covariance = np.triu(second) + np.triu(second, 1).T - np.outer(mean, mean)
                scale = np.sqrt(np.maximum(np.diag(covariance), 0))
                scale = np.where(scale <= 1e-12, 1.0, scale)
                values, vectors = np.linalg.eigh(covariance / np.outer(scale, scale))
                axes = vectors[:, values > least]
                share = values[values > least].sum() / max(values.sum(), 1e-300)
                out.append((name, mean.tolist(), scale.tolist(), (axes @ axes.T).ravel().tolist(), axes.shape[1], float(share)))
            yield pd.DataFrame(out, columns=[SEQUENCE, "mean", "scale", "projector", "kept", "explained"])

    return moments.mapInPandas(run, f"{SEQUENCE} string, mean array<double>, scale array<double>, projector array<double>, kept int, explained double")


def pca_residuals(df: DataFrame, columns: list[str], models: DataFrame, key: str = SEQUENCE) -> DataFrame:
    """Squared distance of each normalised value to its projection, with the model of the row's ``key``; null where a value is null."""
    width, names = len(columns), df.columns

    def run(batches):
        for batch in batches:
            mean, scale, projector = (np.asarray(batch.column(c).flatten()).reshape(-1, size) for c, size in (("mean", width), ("scale", width), ("projector", width * width)))
            z = [(batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) - mean[:, k]) / scale[:, k] for k, c in enumerate(columns)]
            missing = np.any([batch.column(c).is_null() for c in columns], axis=0)
            out = []
            for k in range(width):
                back = projector[:, k * width] * z[0]
                for j in range(1, width):
                    back = back + projector[:, k * width + j] * z[j]
                out.append(pa.array(np.square(z[k] - back), mask=missing))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + out, [*names, *(f"r_{c}" for c in columns)])

    joined = df.join(models.select(F.col(SEQUENCE).alias(key), "mean", "scale", "projector"), key).select(*names, "mean", "scale", "projector")
    return joined.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), *(f"`r_{c}` double" for c in columns)]))


def search_trials(spark: SparkSession, grid: dict[str, list], count: int, seed: int) -> DataFrame:
    """``count`` settings of a grid by seeded shuffle, drawn again where the grid is too small."""
    settings = [{}]
    for name, values in grid.items():
        settings = [s | {name: v} for s in settings for v in values]
    rng = random.Random(seed)
    rng.shuffle(settings)
    chosen = settings[:count] + [rng.choice(settings) for _ in range(max(0, count - len(settings)))]
    return spark.createDataFrame([(i + 1, *map(str, s.values())) for i, s in enumerate(chosen)], ", ".join(["trial int", *(f"{n} string" for n in grid)]))
