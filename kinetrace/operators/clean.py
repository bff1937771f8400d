"""Cleaning and validation of telemetry tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import in_time, norm
from ..functions.contracts import QUATERNION, SEQUENCE, STEP, TIME


def overlap_trim(imu: DataFrame, gt: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both tables cut to the time that they share, ends included, and the manifest of it.

    One aggregate per table, then a join with a row per sequence.  A sequence whose tables share no
    time stops the job with its name.
    """

    def span(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(SEQUENCE).agg(F.min(TIME).alias(f"{name}_first"), F.max(TIME).alias(f"{name}_last"), F.count(F.lit(1)).alias(f"{name}_rows_before"))

    spans = span(imu, "imu").join(span(gt, "gt"), SEQUENCE)
    spans = spans.withColumns({"overlap_start_ns": F.greatest("imu_first", "gt_first"), "overlap_end_ns": F.least("imu_last", "gt_last")})
    apart = F.raise_error(F.concat(F.lit("no overlap in "), F.col(SEQUENCE))).cast("long")
    spans = spans.withColumn("overlap_start_ns", F.when(F.col("overlap_start_ns") > F.col("overlap_end_ns"), apart).otherwise(F.col("overlap_start_ns")))
    bounds = spans.select(SEQUENCE, "overlap_start_ns", "overlap_end_ns")

    def cut(df: DataFrame) -> DataFrame:
        return df.join(bounds, SEQUENCE).where(F.col(TIME).between(F.col("overlap_start_ns"), F.col("overlap_end_ns"))).select(df.columns)

    imu_cut, gt_cut = cut(imu), cut(gt)
    after = [d.groupBy(SEQUENCE).agg(F.count(F.lit(1)).alias(f"{n}_rows_after")) for d, n in ((imu_cut, "imu"), (gt_cut, "gt"))]
    manifest = spans.join(after[0], SEQUENCE, "left").join(after[1], SEQUENCE, "left").na.fill(0, ["imu_rows_after", "gt_rows_after"])
    return imu_cut, gt_cut, manifest.select(SEQUENCE, "overlap_start_ns", "overlap_end_ns", "imu_rows_before", "imu_rows_after", "gt_rows_before", "gt_rows_after")


def first_seconds(df: DataFrame, seconds: float) -> DataFrame:
    """Rows of each sequence's first seconds, for plots."""
    first = df.groupBy(SEQUENCE).agg(F.min(TIME).alias("__first"))
    return df.join(first, SEQUENCE).where(F.col(TIME) <= F.col("__first") + int(seconds * 1e9)).select(df.columns)


def first_rows(df: DataFrame, rows: int) -> DataFrame:
    """Each sequence's first rows, for plots."""
    return df.where(F.col(STEP) < rows)


def order_violations(df: DataFrame, file_order: str) -> DataFrame:
    """Rows per sequence whose time does not exceed the one before, as they come."""
    step = F.col(TIME) - F.lag(TIME).over(Window.partitionBy(SEQUENCE).orderBy(file_order))
    return df.withColumn("step", step).groupBy(SEQUENCE).agg(F.count_if(F.col("step") <= 0).alias("violations"))


def null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and NaNs of each column, per sequence."""
    bad = df.groupBy(SEQUENCE).agg(*(F.count_if(F.col(c).isNull() | F.isnan(c)).alias(c) for c in columns))
    return bad.unpivot([SEQUENCE], columns, "column_name", "violations")


def repair_quaternion_signs(df: DataFrame, columns: list[str] = QUATERNION, keys: tuple[str, ...] = (SEQUENCE,)) -> DataFrame:
    """Flip quaternions so that neighbours never point apart.

    The sign is (-1) to the number of negative dot products since the last one
    that is 0: both are running counts.
    """
    w = in_time(*keys)
    dot = reduce(lambda a, b: a + b, (F.col(c) * F.lag(c).over(w) for c in columns))
    df = df.withColumn("__dot", dot)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__part", F.count_if(F.coalesce(F.col("__dot") == 0, F.lit(True))).over(run))
    inside = Window.partitionBy(*keys, "__part").orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    sign = F.when(F.count_if(F.col("__dot") < 0).over(inside) % 2 == 1, -1.0).otherwise(1.0)
    return df.withColumn("__sign", sign).withColumns({c: F.col(c) * F.col("__sign") for c in columns}).drop("__dot", "__part", "__sign")


def norm_violations(df: DataFrame, columns: list[str] = QUATERNION, absolute: float = 1e-4, relative: float = 1e-5) -> DataFrame:
    """Quaternions whose length is not 1, per sequence."""
    off = F.abs(norm(*columns) - 1.0) > absolute + relative
    return df.groupBy(SEQUENCE).agg(F.count(F.lit(1)).alias("row_count"), F.count_if(off).alias("violations"))


def clean_validation(imu: DataFrame, gt: DataFrame, imu_columns: list[str], gt_columns: list[str], gt_quaternion: list[str]) -> DataFrame:
    """(rule, sequence, violations) of both tables."""

    def rule(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("rule"), SEQUENCE, F.col("violations").cast("long").alias("violations"))

    def steps(df: DataFrame) -> DataFrame:
        d = F.col(TIME) - F.lag(TIME).over(in_time())
        return df.withColumn("d", d).groupBy(SEQUENCE).agg(F.count_if(F.col("d") <= 0).alias("violations"))

    def nulls(df: DataFrame, columns: list[str]) -> DataFrame:
        return null_violations(df, columns).groupBy(SEQUENCE).agg(F.sum("violations").alias("violations"))

    dot = reduce(lambda a, b: a + b, (F.col(c) * F.lag(c).over(in_time()) for c in gt_quaternion))
    apart = gt.withColumn("dot", dot).groupBy(SEQUENCE).agg(F.count_if(F.col("dot") < 0).alias("violations"))
    parts = [rule(nulls(imu, imu_columns), "imu_null"), rule(nulls(gt, gt_columns), "gt_null"), rule(steps(imu), "imu_order"), rule(steps(gt), "gt_order"), rule(apart, "gt_quaternion")]
    return reduce(DataFrame.unionByName, parts)


def raise_on_violation(violations: DataFrame) -> None:
    """Stop with the rules that are broken; rules times sequences come to the driver."""
    broken = violations.where("violations > 0").collect()
    if broken:
        raise ValueError("; ".join(f"{r['rule']} in {r[SEQUENCE]}: {r['violations']}" for r in broken))
