"""Quality report over feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..functions.contracts import GT_CONTEXT, SEQUENCE, TIME
from .quantiles import exact_quantiles


def sequence_feature_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Statistics of each sequence's features over finite values."""
    spans = df.groupBy(SEQUENCE).agg(((F.max(TIME) - F.min(TIME)) / 1e9).alias("duration_s"))
    long = df.unpivot([SEQUENCE], columns, "feature_name", "raw").withColumn("x", finite("raw"))
    q = exact_quantiles(long, [SEQUENCE, "feature_name"], "x", [0.01, 0.5, 0.99])
    stats = long.groupBy(SEQUENCE, "feature_name").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg(F.col("x").isNull().cast("double")).alias("missing_rate"),
        F.avg("x").alias("mean"),
        F.stddev_pop("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    return stats.join(q, [SEQUENCE, "feature_name"], "left").join(spans, SEQUENCE).select(SEQUENCE, "feature_name", "row_count", "duration_s", "missing_rate", "mean", "std", "min", F.col("q")[0].alias("p01"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p99"), "max")


def feature_drift(df: DataFrame, folds: DataFrame, columns: list[str]) -> DataFrame:
    """Distance of validation means from training means, in training deviations.

    Each (sequence, feature) is summed once and the sums are combined by fold.
    """
    long = df.unpivot([SEQUENCE], columns, "feature_name", "raw").withColumn("x", finite("raw"))
    sums = long.groupBy(SEQUENCE, "feature_name").agg(F.count(F.lit(1)).alias("rows"), F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    sides = folds.select("fold_name", F.explode("train").alias(SEQUENCE), F.lit("train").alias("side")).unionByName(folds.select("fold_name", F.col("validation").alias(SEQUENCE), F.lit("validation").alias("side")))
    pooled = sides.join(sums, SEQUENCE).groupBy("fold_name", "feature_name", "side").agg(
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"),
        (F.sum(F.col("n") * (F.col("v") + F.col("m") * F.col("m"))) / F.sum("n")).alias("square"),
        (F.lit(1.0) - F.sum("n") / F.sum("rows")).alias("missing"),
    )
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    wide = pooled.groupBy("fold_name", "feature_name").agg(pick("train", "mean").alias("train_mean"), pick("train", "square").alias("square"), pick("validation", "mean").alias("validation_mean"), pick("train", "missing").alias("train_missing_rate"), pick("validation", "missing").alias("validation_missing_rate"))
    std = F.sqrt(F.greatest(F.col("square") - F.col("train_mean") * F.col("train_mean"), F.lit(0.0)))
    drift = F.abs(F.col("train_mean") - F.col("validation_mean")) / F.greatest(std, F.lit(1e-12))
    return wide.select("fold_name", "feature_name", "train_mean", "validation_mean", drift.alias("standardized_mean_difference"), "train_missing_rate", "validation_missing_rate")


def qa_summary(stats: DataFrame, drift: DataFrame) -> DataFrame:
    """Worst missing rates and drift, and what to do about them."""
    gt = F.col("feature_name").isin(GT_CONTEXT)
    worst = stats.agg(F.max(F.when(~gt, F.col("missing_rate"))).alias("max_model_missing_rate"), F.max(F.when(gt, F.col("missing_rate"))).alias("max_gt_missing_rate"))
    top = drift.where(~gt).agg(F.max("standardized_mean_difference").alias("max_standardized_mean_difference"))
    advice = F.when(F.col("max_model_missing_rate") > 0, "fix_before_modeling").when((F.col("max_gt_missing_rate") > 0.10) | (F.col("max_standardized_mean_difference") > 5), "proceed_with_caveats").otherwise("proceed")
    return worst.join(top).withColumn("recommendation", advice)


def fold_window_counts(windows: DataFrame) -> DataFrame:
    return windows.groupBy("fold_name", "split_name", "stride").agg(F.count(F.lit(1)).alias("window_count"))


def markdown_summary(summary: DataFrame, drift: DataFrame, top: int = 5) -> str:
    """The report as text: one row of worst values and the features that drift most."""
    s = summary.first().asDict()
    lines = ["# Quality report", "", *(f"- {k}: {v}" for k, v in s.items()), "", "| fold | feature | drift |", "| --- | --- | --- |"]
    rows = drift.orderBy(F.desc("standardized_mean_difference"), "fold_name", "feature_name").limit(top).collect()
    return "\n".join([*lines, *(f"| {r['fold_name']} | {r['feature_name']} | {r['standardized_mean_difference']:.3f} |" for r in rows)]) + "\n"
