"""Profiles of raw tables: time stamps, missing cells, inventory of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contracts import SEQUENCE, TIME
from .quantiles import exact_quantiles


def timestamp_summary(df: DataFrame, file_order: str) -> DataFrame:
    """Span, median positive step, rate, repeated and backward steps, in file order."""
    step = F.col(TIME) - F.lag(TIME).over(Window.partitionBy(SEQUENCE).orderBy(file_order))
    steps = df.withColumn("d", step)
    middle = exact_quantiles(steps.where("d > 0"), [SEQUENCE], "d", [0.5]).select(SEQUENCE, F.col("q")[0].alias("m"))
    stats = steps.groupBy(SEQUENCE).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(TIME).alias("first_ns"),
        F.max(TIME).alias("last_ns"),
        F.count_if(F.col("d") == 0).alias("duplicate_count"),
        F.count_if(F.col("d") < 0).alias("non_monotonic_count"),
    )
    return stats.join(middle, SEQUENCE, "left").select(
        SEQUENCE,
        "row_count",
        "first_ns",
        "last_ns",
        ((F.col("last_ns") - F.col("first_ns")) / 1e9).alias("duration_s"),
        (F.col("m") / 1e9).alias("median_step_s"),
        F.try_divide(F.lit(1e9), F.col("m")).alias("rate_hz"),
        "duplicate_count",
        "non_monotonic_count",
    )


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(sequence, column, missing): cells that are null or blank text."""
    counts = df.groupBy(SEQUENCE).agg(*(F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c) for c in columns))
    return counts.unpivot([SEQUENCE], columns, "column_name", "missing")


def csv_profile(df: DataFrame, columns: list[str], file_order: str) -> DataFrame:
    """Rows, columns, missing cells by column, span, rate and status of each sequence."""
    missing = missing_counts(df, columns).groupBy(SEQUENCE).agg(F.sum("missing").alias("missing_total"), F.max(F.struct("missing", "column_name"))["missing"].alias("missing_most"))
    times = timestamp_summary(df, file_order).select(SEQUENCE, "row_count", "duration_s", "rate_hz")
    return times.join(missing, SEQUENCE).withColumns({"column_count": F.lit(len(columns)), "status": F.when(F.col("row_count") > 0, "ok").otherwise("empty")})


def raw_manifest(listing: DataFrame, sequences: DataFrame) -> DataFrame:
    """What each expected sequence has among listed files (sequence, file)."""
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    found = listing.groupBy(SEQUENCE).agg(
        has(F.col("file") == "imu_data.csv").alias("has_imu_csv"),
        has(F.col("file").endswith("_gt.zip")).alias("has_gt_zip"),
        has(F.col("file").endswith("_folder.zip")).alias("has_folder_zip"),
        has(F.col("file") == "calibration.yaml").alias("has_calibration"),
        F.array_join(F.sort_array(F.collect_set("file")), ",").alias("files"),
    )
    flags = ["has_imu_csv", "has_gt_zip", "has_folder_zip", "has_calibration"]
    return sequences.join(found, SEQUENCE, "left").na.fill(False, flags).na.fill("", ["files"])
