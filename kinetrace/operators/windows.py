"""Sliding windows over row numbers, and what is checked and chosen among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import in_time
from ..functions.contracts import SEQUENCE, STEP, TIME, WINDOW


def window_index(df: DataFrame, size: int, stride: int) -> DataFrame:
    """Full windows of each sequence: rows and times of their first and last row."""
    ends = df.withColumn("end_timestamp_ns", F.lead(TIME, size - 1).over(in_time()))
    starts = ends.where((F.col(STEP) % stride == 0) & F.col("end_timestamp_ns").isNotNull())
    return starts.select(
        SEQUENCE,
        F.lit(size).cast("long").alias("window_size"),
        F.lit(stride).cast("long").alias("stride"),
        F.col(STEP).cast("long").alias("start_row"),
        (F.col(STEP) + size - 1).cast("long").alias("end_row"),
        F.col(TIME).alias("start_timestamp_ns"),
        "end_timestamp_ns",
    )


def fold_windows(folds: DataFrame, index: DataFrame) -> DataFrame:
    """Windows of the sequences that each fold trains on and validates with."""
    sides = folds.select("fold_name", F.explode("train").alias(SEQUENCE), F.lit("train").alias("split_name")).unionByName(
        folds.select("fold_name", F.col("validation").alias(SEQUENCE), F.lit("validation").alias("split_name"))
    )
    return sides.join(index, SEQUENCE)


def last_fold_wins(windows: DataFrame) -> DataFrame:
    """One row per window; of those in several folds the last."""
    w = Window.partitionBy(SEQUENCE, "start_row", "end_row").orderBy(F.desc("fold_name"))
    return windows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def tail_split(windows: DataFrame) -> DataFrame:
    """The last tenth of the windows, one at least, is for validation.

    The order is (sequence, start); the rank is worked out from counts per
    sequence, of which there are few, and the rank inside a sequence.
    """
    inside = Window.partitionBy(SEQUENCE).orderBy("start_row")
    counts = windows.groupBy(SEQUENCE).agg(F.count(F.lit(1)).alias("c"))
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy(SEQUENCE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = counts.agg(F.sum("c").alias("total"))
    ranked = windows.withColumn("i", F.row_number().over(inside)).join(before.join(total), SEQUENCE)
    cut = F.col("total") - F.greatest(F.lit(1), F.expr("total div 10"))
    return ranked.withColumn("split_name", F.when(F.col("before") + F.col("i") > cut, "validation").otherwise("train")).drop("i", "c", "before", "total")


def window_violations(index: DataFrame, df: DataFrame) -> DataFrame:
    """(rule, violations): bounds, sizes, and times that differ from the rows they name."""
    rows = df.select(SEQUENCE, F.col(STEP).cast("long").alias("r"), F.col(TIME).alias("t"))
    start, end = rows.toDF(SEQUENCE, "start_row", "start_t"), rows.toDF(SEQUENCE, "end_row", "end_t")
    joined = index.join(start, [SEQUENCE, "start_row"], "left").join(end, [SEQUENCE, "end_row"], "left")
    rules = {
        "bounds": (F.col("start_row") < 0) | (F.col("end_row") < F.col("start_row")),
        "size": F.col("end_row") - F.col("start_row") + 1 != F.col("window_size"),
        "start_time": F.col("start_t").isNull() | (F.col("start_t") != F.col("start_timestamp_ns")),
        "end_time": F.col("end_t").isNull() | (F.col("end_t") != F.col("end_timestamp_ns")),
    }
    counts = joined.agg(*(F.count_if(c).alias(n) for n, c in rules.items()))
    return counts.unpivot([], list(rules), "rule", "violations")


def window_arrays(df: DataFrame, index: DataFrame, columns: list[str]) -> DataFrame:
    """Each window's rows as an array of rows, by an equi-join on row number."""
    wanted = index.select(SEQUENCE, "start_row", F.explode(F.sequence("start_row", "end_row")).alias(STEP))
    rows = wanted.join(df.select(SEQUENCE, STEP, *columns), [SEQUENCE, STEP])
    packed = F.sort_array(F.collect_list(F.struct(STEP, F.array(*columns).alias("v"))))
    return rows.groupBy(SEQUENCE, "start_row").agg(F.transform(packed, lambda s: s["v"]).alias("rows"))


def default_index(df: DataFrame, stride: int) -> DataFrame:
    return window_index(df, WINDOW, stride)
