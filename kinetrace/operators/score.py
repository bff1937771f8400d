"""Reconstruction, window scores, thresholds, alerts and their segments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import in_time, mean_of
from ..functions.contracts import ADAPTIVE_ROWS, GROUPS, RATE_HZ, RAW, SCORE_STRIDE, SEQUENCE, STEP, TIME, WINDOW
from ..sources.scratch import materialize
from . import blocks
from .quantiles import exact_quantiles

INDEX = "window_end_idx"
#: Windows of a part in which trailing medians are worked out; each looks back on 300.
BASELINE_ROWS = 8_000
#: Windows that are copied out of a part's rows together; what stands for a time that is null.
WINDOWS_AT_ONCE, NO_TIME = 512, -(1 << 63)


def trailing_mean_residuals(df: DataFrame, columns: list[str] = RAW, rows: int = 25) -> DataFrame:
    """Squared distance to the mean of the rows before; 0 on a first row."""
    before = Window.partitionBy(SEQUENCE, blocks.PART).orderBy(STEP).rowsBetween(-rows, -1)
    parted = blocks.with_halo(df, STEP, rows)
    return blocks.own(parted.withColumns({f"r_{c}": F.coalesce(F.pow(F.col(c) - F.avg(c).over(before), F.lit(2.0)), F.lit(0.0)) for c in columns}))


def previous_value_residuals(df: DataFrame, columns: list[str] = RAW) -> DataFrame:
    """Squared distance to the row before; 0 on a first row."""
    return df.withColumns({f"r_{c}": F.coalesce(F.pow(F.col(c) - F.lag(c).over(in_time()), F.lit(2.0)), F.lit(0.0)) for c in columns})


def top_mean(values: Column, k: int) -> Column:
    """Mean of the k largest."""
    return F.aggregate(F.slice(F.sort_array(values, asc=False), 1, k), F.lit(0.0), lambda a, x: a + x) / k


def top_group() -> Column:
    """Group of the largest score; the first of equals."""
    q, g, a = (F.col(f"{n}_score") for n in GROUPS)
    return F.when((q >= g) & (q >= a), "quaternion").when(g >= a, "gyro").otherwise("accel")


def _trailing_residuals(table: pa.Table, columns: list[str], rows: int) -> dict[str, np.ndarray]:
    """``trailing_mean_residuals`` of a part's rows in order; the rows before are added up from the farthest, as a frame adds them."""
    out = {}
    for c in columns:
        x, here = table.column(c).fill_null(0.0).to_numpy(), table.column(c).is_valid().to_numpy()
        total, count = np.zeros(len(x)), np.zeros(len(x), np.int64)
        for back in range(rows, 0, -1):
            total[back:] += x[:-back]
            count[back:] += here[:-back]
        found = here & (count > 0)
        out[c] = np.zeros(len(x))
        out[c][found] = (x[found] - total[found] / count[found]) ** 2
    return out


def _windows_of(size: int, stride: int, k: int, names: list[str], cells):
    """Full windows of a part's rows, and a row without a window that has the part's first time; ``cells`` gives the rows' values by name."""

    def run(table):
        table = table.sort_by("b")
        values = cells(table)
        b, own = table.column("b").to_numpy(), table.column(blocks.OWN).to_numpy()
        n = max(0, len(b) - size + 1)
        begins = np.flatnonzero((b[:n] % stride == 0) & own[:n] & (b[size - 1 :] - b[:n] == size - 1) if n else [])
        view = lambda rows: sliding_window_view(rows, size)
        at_times = table.column(TIME).fill_null(NO_TIME).to_numpy()
        found = {name: np.empty(len(begins)) for name in names}
        ends = np.empty(len(begins), np.int64)
        for at in (slice(i, i + WINDOWS_AT_ONCE) for i in range(0, len(begins), WINDOWS_AT_ONCE)):
            ends[at] = view(at_times)[begins[at]].max(axis=1)
            for name in names:
                # The largest first, as they are added; a null, which counts for nothing, comes last.
                top = np.sort(np.partition(view(values[name])[begins[at]], size - k, axis=1)[:, size - k :], axis=1)[:, ::-1]
                found[name][at] = sum(np.where(top == -np.inf, 0.0, top).T) / k
        first = pc.min(table.column(TIME).filter(table.column(blocks.OWN))).as_py()
        start, nothing = b[begins], pa.nulls(1, pa.float64())
        times = pa.array(ends, mask=ends == NO_TIME)
        columns = [pa.repeat(table.column(SEQUENCE)[0], len(start) + 1), *(pa.concat_arrays([pa.array(c, pa.int64()), pa.nulls(1, pa.int64())]) for c in (start, start + size - 1))]
        columns += [pa.concat_arrays([times, pa.array([first], pa.int64())]), *(pa.concat_arrays([pa.array(found[name]), nothing]) for name in names)]
        return pa.table(columns, [SEQUENCE, "window_start_idx", INDEX, TIME, *names])

    return run


def window_scores(residuals: DataFrame, columns: list[str] = RAW, size: int = WINDOW, stride: int = SCORE_STRIDE) -> DataFrame:
    """Score timeline: a row per full window, with scores in all and by group.

    A window's score is the mean of the largest twentieth of its rows' residuals.
    Rows go to parts of their sequence, with copies of those that a part looks ahead to; a
    part's windows are cut from its rows by one task, and its first time comes along, so
    ``residuals`` are worked out once.  The windows are written.
    """
    cells = {"score": mean_of([f"r_{c}" for c in columns]), **{f"{n}_score": mean_of([f"r_{c}" for c in group]) for n, group in GROUPS.items()}}
    rows = residuals.select(*_place(), *(c.cast("double").alias(n) for n, c in cells.items()))
    names = list(cells)
    return _timeline(rows, names, lambda table: {n: table.column(n).fill_null(-np.inf).to_numpy() for n in names}, 0, size, stride)


def trailing_mean_scores(df: DataFrame, columns: list[str] = RAW, rows: int = 25, size: int = WINDOW, stride: int = SCORE_STRIDE) -> DataFrame:
    """``window_scores`` of ``trailing_mean_residuals``, both worked out by the task that cuts a part's windows."""
    groups = {"score": columns, **{f"{n}_score": group for n, group in GROUPS.items()}}

    def cells(table):
        squares = _trailing_residuals(table, columns, rows)
        return {name: sum((squares[c] for c in group[1:]), squares[group[0]]) / len(group) for name, group in groups.items()}

    return _timeline(df.select(*_place(), *(F.col(c).cast("double").alias(c) for c in columns)), list(groups), cells, rows, size, stride)


def _place() -> list[Column]:
    return [F.col(SEQUENCE), F.col(TIME).cast("long").alias(TIME), F.col(STEP).cast("long").alias("b")]


def _timeline(rows: DataFrame, names: list[str], cells, before: int, size: int, stride: int) -> DataFrame:
    """Windows cut from ``rows``, whose values ``cells`` finds in a part with ``before`` rows ahead of its own."""
    parted = blocks.with_halo(rows, "b", before, size - 1).groupBy(SEQUENCE, blocks.PART)
    schema = f"{SEQUENCE} string, window_start_idx long, {INDEX} long, {TIME} long, {', '.join(f'{n} double' for n in names)}"
    found = materialize(parted.applyInArrow(_windows_of(size, stride, max(1, -(-size // 20)), names, cells), schema), "windows")
    begins = found.where("window_start_idx is null").groupBy(SEQUENCE).agg(F.min(TIME).alias("t0"))
    timed = found.where("window_start_idx is not null").join(begins, SEQUENCE).withColumn("time_s", (F.col(TIME) - F.col("t0")) / 1e9)
    return timed.select(SEQUENCE, "window_start_idx", INDEX, TIME, "time_s", *names).withColumn("top_group", top_group())


def percentile_threshold(scores: DataFrame, percent: float, by: list[str] | None = None) -> DataFrame:
    """Threshold by linear interpolation between ranks."""
    return exact_quantiles(scores, by or [], "score", [percent / 100]).select(*(by or []), F.col("q")[0].alias("threshold"))


def percentile_thresholds(scores: DataFrame, percents: list[float], by: list[str]) -> DataFrame:
    """(by..., threshold, percent): several thresholds from the same two passes over the scores."""
    q = exact_quantiles(scores, by, "score", [p / 100 for p in percents])
    each = F.explode(F.arrays_zip(F.col("q").alias("threshold"), F.array(*map(F.lit, percents)).alias("percent")))
    return q.select(*by, each.alias("t")).select(*by, "t.threshold", "t.percent")


def persist(df: DataFrame, positive: str, k: int, order: str = INDEX) -> DataFrame:
    """Add alert_active (the last k rows are all positive) and alert_onset."""
    w = Window.partitionBy(SEQUENCE).orderBy(order)
    df = df.withColumn("alert_active", F.sum(F.col(positive).cast("int")).over(w.rowsBetween(-(k - 1), 0)) == k)
    return df.withColumn("alert_onset", F.col("alert_active") & ~F.lag("alert_active", 1, False).over(w))


def annotate(timeline: DataFrame, threshold: DataFrame, k: int = 2) -> DataFrame:
    """Alerts over a global threshold (one row, or a row per sequence)."""
    on = [SEQUENCE] if SEQUENCE in threshold.columns else None
    joined = timeline.join(F.broadcast(threshold), on) if on else timeline.join(F.broadcast(threshold))
    return persist(joined.withColumn("positive", F.coalesce(F.col("score") > F.col("threshold"), F.lit(False))), "positive", k)


def alert_segments(annotated: DataFrame, stride: int = SCORE_STRIDE) -> DataFrame:
    """Runs of active rows: place, time, length, trigger group and peak score."""
    w = Window.partitionBy(SEQUENCE).orderBy(INDEX)
    numbered = annotated.withColumn("segment_id", F.sum(F.col("alert_onset").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("alert_active")
    return numbered.groupBy(SEQUENCE, "segment_id").agg(
        F.min(INDEX).alias("start_idx"),
        F.max(INDEX).alias("end_idx"),
        F.min("time_s").alias("start_time_s"),
        F.max("time_s").alias("end_time_s"),
        F.count(F.lit(1)).alias("row_count"),
        (F.count(F.lit(1)) * stride / RATE_HZ).alias("duration_s"),
        F.min_by("top_group", INDEX).alias("trigger_group"),
        F.max("score").alias("peak_score"),
    )


def adaptive_baseline(timeline: DataFrame, rows: int = ADAPTIVE_ROWS) -> DataFrame:
    """Median of the rows before, and median distance to it; own score and 0 on a first row."""
    numbers = blocks.numbered(timeline, [SEQUENCE], INDEX, [INDEX], "__row")
    before = Window.partitionBy(SEQUENCE, blocks.PART).orderBy("__row").rowsBetween(-rows, -1)
    parted = blocks.with_halo(numbers, "__row", rows, rows=BASELINE_ROWS).withColumn("past", F.collect_list("score").over(before))
    df = blocks.own(parted).drop("__row")
    middle = lambda a: (F.get(a, F.expr("(size(past) - 1) div 2")) + F.get(a, F.expr("size(past) div 2"))) / 2
    df = df.withColumn("m", middle(F.sort_array("past")))
    far = F.sort_array(F.transform("past", lambda x: F.abs(x - F.col("m"))))
    df = df.withColumns({"trailing_median": F.coalesce("m", "score"), "trailing_mad": F.when(F.size("past") > 0, middle(far)).otherwise(0.0)})
    return df.drop("m", "past")
