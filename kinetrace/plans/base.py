"""Telemetry views over the star-schema test tables.

``events`` gives sequences and times, ``embeddings`` the channel values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contracts import GT_POSITION, GT_QUATERNION, RAW, SEQUENCE, STEP, TIME
from ..operators import blocks

GRID_NS = 600 * 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with integer nanoseconds, whatever the session's time zone."""
    events = table(spark, sf_dir, "events")
    ns = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) * 1000
    return events.withColumn(TIME, ns).withColumn(SEQUENCE, F.col("event_type"))


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.count()  # from Parquet footers
    events = event_times(spark, sf_dir).select(SEQUENCE, TIME, "event_id", (F.col("event_id") % n).alias("vec_id"))
    return events.join(vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")), "vec_id")


def _unit(first: int):
    cells = [F.col("v")[first + i] for i in range(4)]
    length = F.sqrt(cells[0] * cells[0] + cells[1] * cells[1] + cells[2] * cells[2] + cells[3] * cells[3])
    return [c / length for c in cells]


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor rows: sequence, time, event_id, step, ten raw channels."""
    j = _joined(spark, sf_dir)
    cells = [*_unit(0), *(F.col("v")[i] for i in range(4, 10))]
    rows = j.select(SEQUENCE, TIME, "event_id", *(c.alias(n) for c, n in zip(cells, RAW, strict=True)))
    return blocks.numbered(rows, [SEQUENCE], TIME, [TIME, "event_id"], STEP).select(SEQUENCE, TIME, "event_id", STEP, *RAW)


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pose rows: every fourth event."""
    j = _joined(spark, sf_dir).where(F.col("event_id") % 4 == 0)
    cells = [*(F.col("v")[i] for i in range(10, 13)), *_unit(13)]
    return j.select(SEQUENCE, TIME, "event_id", *(c.alias(n) for c, n in zip(cells, GT_POSITION + GT_QUATERNION, strict=True)))


def lengths(df: DataFrame) -> DataFrame:
    return df.groupBy(SEQUENCE).agg(F.count(F.lit(1)).alias("n"))


def drive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drive rows from orders: only their arithmetic matters."""
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        F.col("o_orderstatus").alias("run"),
        F.substring("o_orderpriority", 1, 1).alias("phase"),
        key.cast("double").alias("t"),
        (F.col("o_totalprice") / 1000).alias("x"),
        ((cust % 100) / 10.0).alias("y"),
        ((key % 7 - 3) / 10.0).alias("vx"),
        ((cust % 5 - 2) / 10.0).alias("vy"),
        ((key % 63) / 10.0 - 3.1).alias("yaw"),
        F.when(key % 4 == 0, 0.0).otherwise(0.25).alias("cmd_speed"),
    )
