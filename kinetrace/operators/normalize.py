"""Folds, normalizers and normalised tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.contracts import SEQUENCE
from .quantiles import exact_quantiles, left_out_quantiles


def loso_folds(df: DataFrame) -> DataFrame:
    """fold_name, train, validation: each sequence is left out once.

    One row holds all names, as there are few sequences.
    """
    names = df.select(SEQUENCE).distinct().agg(F.sort_array(F.collect_list(SEQUENCE)).alias("names"))
    each = names.select("names", F.posexplode("names").alias("i", "validation"))
    return each.select(F.concat(F.lit("fold_"), F.col("i") + 1).alias("fold_name"), F.filter("names", lambda n: n != F.col("validation")).alias("train"), "validation")


def experiments(folds: DataFrame, feature_sets: list[str], modes: list[str]) -> DataFrame:
    """Every fold with every feature set and mode."""
    return folds.withColumn("feature_set", F.explode(F.array(*map(F.lit, feature_sets)))).withColumn("mode", F.explode(F.array(*map(F.lit, modes))))


def _floored(stats: DataFrame) -> DataFrame:
    """Scales of nearly 0 count as 1."""
    return stats.withColumn("scale", F.when(F.abs("scale") <= 1e-12, 1.0).otherwise(F.col("scale")))


def fit(df: DataFrame, columns: list[str], mode: str, by: list[str]) -> DataFrame:
    """(by..., column_name, center, scale); a scale of nearly 0 counts as 1."""
    if mode not in ("zscore", "robust"):
        raise ValueError(f"unknown mode: {mode}")
    long = df.unpivot(by, columns, "column_name", "value")
    if mode == "zscore":
        stats = long.groupBy(*by, "column_name").agg(F.avg("value").alias("center"), F.stddev_pop("value").alias("scale"))
    else:
        stats = exact_quantiles(long, [*by, "column_name"], "value", [0.25, 0.5, 0.75]).select(*by, "column_name", F.col("q")[1].alias("center"), (F.col("q")[2] - F.col("q")[0]).alias("scale"))
    return _floored(stats)


def fit_folds(df: DataFrame, folds: DataFrame, columns: list[str], mode: str) -> DataFrame:
    """A normalizer per fold that leaves one sequence out (``loso_folds``), from all the others.

    Means and deviations are put together from one sum per sequence, quantiles from counts of
    cells of values, all less the fold's own: rows are not multiplied by folds.
    """
    sides = folds.select("fold_name", F.explode("train").alias(SEQUENCE))
    if mode == "robust":
        known = df.join(folds.select(F.col("validation").alias(SEQUENCE)), SEQUENCE, "left_semi")
        values = known.unpivot([SEQUENCE], columns, "g", "x").select("g", F.col(SEQUENCE).alias("part"), F.col("x").cast("double").alias("x"))
        parts = folds.select(F.explode(F.array(*map(F.lit, columns))).alias("g"), F.col("validation").alias("part"))
        found = left_out_quantiles(values, [0.25, 0.5, 0.75], parts=parts)
        stats = folds.select("fold_name", F.col("validation").alias("part")).join(found, "part").select("fold_name", F.col("g").alias("column_name"), F.col("q")[1].alias("center"), (F.col("q")[2] - F.col("q")[0]).alias("scale"))
        return _floored(stats)
    if mode != "zscore":
        raise ValueError(f"unknown mode: {mode}")
    # Chan's formula, sequence by sequence: distances to a sequence's mean, then of the means to the fold's.
    own = df.unpivot([SEQUENCE], columns, "column_name", "value").groupBy(SEQUENCE, "column_name").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    each = sides.join(own, SEQUENCE)
    total = F.sum("n")
    center = F.sum(F.col("n") * F.col("m")) / total
    means = each.groupBy("fold_name", "column_name").agg(F.when(total > 0, center).alias("center"))
    spread = F.sqrt(F.sum(F.col("n") * (F.col("v") + F.pow(F.col("m") - F.col("center"), F.lit(2.0)))) / total)
    stats = each.join(means, ["fold_name", "column_name"]).groupBy("fold_name", "column_name").agg(F.first("center").alias("center"), F.when(total > 0, spread).alias("scale"))
    return _floored(stats)


def as_payload(fitted: DataFrame, folds: DataFrame, columns: list[str], mode: str) -> DataFrame:
    """One row per fold as it is stored: mode, provenance, ordered columns, maps of centers and scales."""
    pair = lambda v: F.map_from_entries(F.sort_array(F.collect_list(F.struct("column_name", v))))
    maps = fitted.groupBy("fold_name").agg(pair("center").alias("center"), pair("scale").alias("scale"))
    return maps.join(folds.select("fold_name", F.col("train").alias("fitted_sequence_names")), "fold_name").withColumns({"mode": F.lit(mode), "feature_columns": F.array(*map(F.lit, columns))})


def payload_violations(stored: DataFrame, folds: DataFrame, columns: list[str], mode: str) -> DataFrame:
    """(fold, rule) of stored normalizers that do not fit their fold, mode or columns."""
    wanted = F.array(*map(F.lit, columns))
    covers = lambda m: F.array_sort(F.map_keys(m)) == F.array_sort(wanted)
    rules = {"mode": F.col("mode") != mode, "provenance": F.col("fitted_sequence_names") != F.col("train"), "columns": F.col("feature_columns") != wanted, "center": ~covers("center"), "scale": ~covers("scale")}
    joined = stored.join(folds.select("fold_name", "train"), "fold_name")
    found = F.filter(F.array(*(F.when(bad, F.lit(rule)) for rule, bad in rules.items())), lambda x: x.isNotNull())
    return joined.select("fold_name", F.explode(found).alias("rule"))


def apply(df: DataFrame, normalizer: DataFrame, columns: list[str]) -> DataFrame:
    """(x - center) / scale with a one-row table of centers and scales."""
    picks = [F.max(F.when(F.col("column_name") == c, F.struct("center", "scale"))).alias(f"__{c}") for c in columns]
    wide = normalizer.agg(*picks)
    return df.join(F.broadcast(wide)).select(*(((F.col(c) - F.col(f"__{c}.center")) / F.col(f"__{c}.scale")).alias(c) if c in columns else F.col(c) for c in df.columns))
