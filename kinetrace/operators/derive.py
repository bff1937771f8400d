"""Derived motion features and ground-truth context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import fold_angle, in_time, norm, require_columns, yaw
from ..functions.contracts import ACCEL, GT_POSITION, GT_QUATERNION, GYRO, SEQUENCE, TIME


def seconds_since_previous(w) -> Column:
    """Seconds since the row before; null for none, or for no time at all."""
    dt = (F.col(TIME) - F.lag(TIME).over(w)) / 1e9
    return F.when(dt > 0, dt)


def difference_norm(columns: list[str], w) -> Column:
    """Norm of backward differences a second; 0 where there is none."""
    dt = seconds_since_previous(w)
    parts = [(F.col(c) - F.lag(c).over(w)) / dt for c in columns]
    return F.coalesce(norm(*parts), F.lit(0.0))


def trailing_rms(column: str, rows: int, w) -> Column:
    return F.sqrt(F.avg(F.col(column) * F.col(column)).over(w.rowsBetween(-(rows - 1), 0)))


def derive_imu_features(df: DataFrame, rms_rows: int = 25, keys: tuple[str, ...] = (SEQUENCE,)) -> DataFrame:
    """Six features of gyro and accel; one sort per sequence serves all windows."""
    require_columns(df, GYRO + ACCEL)
    w = in_time(*keys)
    df = df.withColumns({"gyro_norm": norm(*GYRO), "accel_norm": norm(*ACCEL)})
    return df.withColumns(
        {
            "angular_accel_norm": difference_norm(GYRO, w),
            "jerk_norm": difference_norm(ACCEL, w),
            "gyro_rms_local": trailing_rms("gyro_norm", rms_rows, w),
            "accel_rms_local": trailing_rms("accel_norm", rms_rows, w),
        }
    )


def unwrap(column: str, w) -> Column:
    """Angle without jumps: a running sum of what each jump folds to."""
    return F.col(column) + F.sum(F.coalesce(F.col("__fold"), F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))


def unwrapped_yaw(df: DataFrame, keys: tuple[str, ...] = (SEQUENCE,)) -> DataFrame:
    """Add ``yaw`` of the pose quaternion, unwrapped in time."""
    w = in_time(*keys)
    df = df.withColumn("__yaw", yaw(*GT_QUATERNION))
    df = df.withColumn("__fold", fold_angle(F.col("__yaw") - F.lag("__yaw").over(w)))
    return df.withColumn("yaw", unwrap("__yaw", w)).drop("__yaw", "__fold")


def gt_context(gt: DataFrame, keys: tuple[str, ...] = (SEQUENCE,)) -> DataFrame:
    """Speeds, yaw and yaw rate at the poses' own rate; the first row has yaw alone.

    Times are subtracted as integers, then scaled.
    """
    w = in_time(*keys)
    dt = seconds_since_previous(w)
    df = unwrapped_yaw(gt, keys).withColumns({f"__v{i}": (F.col(c) - F.lag(c).over(w)) / dt for i, c in enumerate(GT_POSITION)})
    return df.select(
        *keys,
        TIME,
        norm("__v0", "__v1", "__v2").alias("gt_speed_mps"),
        norm("__v0", "__v1").alias("gt_horizontal_speed_mps"),
        F.abs("__v2").alias("gt_vertical_speed_mps"),
        F.col("yaw").alias("gt_yaw_rad"),
        ((F.col("yaw") - F.lag("yaw").over(w)) / dt).alias("gt_yaw_rate_rps"),
    )


def unwrap_by_steps(df: DataFrame, angle: str, keys: tuple[str, ...] = (SEQUENCE,)) -> DataFrame:
    """Add ``yaw_unwrapped``: one turn added or taken where an angle jumps by more than pi."""
    import math

    w = in_time(*keys)
    jump = F.col(angle) - F.lag(angle).over(w)
    turn = F.when(jump > math.pi, -2 * math.pi).when(jump < -math.pi, 2 * math.pi).otherwise(0.0)
    df = df.withColumn("__turn", turn)
    return df.withColumn("yaw_unwrapped", F.col(angle) + F.sum("__turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__turn")
