"""Uniform grids, interpolation as of both neighbours, and low-pass filters."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import in_time, norm
from ..functions.contracts import ACCEL, GYRO, QUATERNION, SEQUENCE, STEP, TIME
from ..sources.scratch import materialize
from . import blocks
from .clean import repair_quaternion_signs
from .quantiles import exact_quantiles


def uniform_grid(df: DataFrame, step_ns: int) -> DataFrame:
    """(sequence, time) from each sequence's first row by ``step_ns`` up to its last."""
    spans = df.groupBy(SEQUENCE).agg(F.min(TIME).alias("a"), F.max(TIME).alias("b"))
    return spans.select(SEQUENCE, F.explode(F.sequence("a", "b", F.lit(step_ns))).alias(TIME))


def interpolate(grid: DataFrame, source: DataFrame, columns: list[str], clamp_ends: bool) -> DataFrame:
    """Values of ``source`` on the times of ``grid``, between both neighbours.

    Grid and source rows are sorted together in parts of time, once in each direction; the last row
    before and the first row after are taken over ranges of time, so rows at the
    same time see each other.  Outside the source's span the value is the nearest one if
    ``clamp_ends``, else null.
    """
    cell = F.struct(F.col(TIME).alias("t"), *columns)
    both = source.select(SEQUENCE, TIME, cell.alias("s"), F.lit(False).alias("on_grid")).unionByName(
        grid.select(SEQUENCE, TIME).withColumns({"s": F.lit(None).cast(source.select(cell.alias("s")).schema["s"].dataType), "on_grid": F.lit(True)})
    )
    # A part gets the source's last row before it and the first one behind it as rows of its own.
    parted = blocks.by_time(materialize(both, "to-interpolate"), TIME)
    ends = [blocks.carried(parted, [SEQUENCE], F.col("s"), F.col(TIME), last).select(SEQUENCE, F.col("c.t").alias(TIME), F.col("c").alias("s"), F.lit(False).alias("on_grid"), blocks.PART) for last in (True, False)]
    both = parted.unionByName(ends[0]).unionByName(ends[1])
    # Both frames grow from their start, so each is one pass; a frame that looks ahead would be quadratic.
    latest, keys = F.last("s", ignorenulls=True), [SEQUENCE, blocks.PART]
    before = latest.over(Window.partitionBy(*keys).orderBy(TIME).rangeBetween(Window.unboundedPreceding, 0))
    after = latest.over(Window.partitionBy(*keys).orderBy(F.desc(TIME)).rangeBetween(Window.unboundedPreceding, 0))
    both = both.withColumns({"a": before, "b": after}).where("on_grid")
    part = F.when(F.col("a.t") == F.col("b.t"), 0.0).otherwise((F.col(TIME) - F.col("a.t")) / (F.col("b.t") - F.col("a.t")))

    def value(c: str):
        lerp = F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * part
        return F.coalesce(lerp, F.col(f"a.{c}"), F.col(f"b.{c}")) if clamp_ends else F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), lerp)

    return both.select(SEQUENCE, TIME, *(value(c).alias(c) for c in columns))


def source_rate(df: DataFrame) -> DataFrame:
    """Samples a second: one over the median step."""
    steps = df.withColumn("d", F.col(TIME) - F.lag(TIME).over(in_time()))
    return exact_quantiles(steps, [SEQUENCE], "d", [0.5]).select(SEQUENCE, (F.lit(1e9) / F.col("q")[0]).alias("source_rate_hz"))


def renormalize(df: DataFrame, columns: list[str] = QUATERNION) -> DataFrame:
    """Quaternions of length 1; a zero one stops the job."""
    df = df.withColumn("__n", norm(*columns))
    df = df.withColumn("__n", F.when(F.col("__n") > 0, F.col("__n")).otherwise(F.raise_error(F.lit("zero quaternion")).cast("double")))
    return df.withColumns({c: F.col(c) / F.col("__n") for c in columns}).drop("__n")


def butterworth_sos(order: int, cutoff_hz: float, rate_hz: float) -> np.ndarray:
    """Second-order sections of a low-pass, by the bilinear transform; (order/2, 6)."""
    k = np.arange(order // 2)
    warped = 2 * rate_hz * math.tan(math.pi * cutoff_hz / rate_hz)
    poles = warped * np.exp(1j * math.pi * (2 * k + order + 1) / (2 * order))
    z = (2 * rate_hz + poles) / (2 * rate_hz - poles)
    a1, a2 = -2 * z.real, np.abs(z) ** 2
    gain = (1 + a1 + a2) / 4
    return np.stack([gain, 2 * gain, gain, np.ones_like(gain), a1, a2], axis=1)


def _sections(sos: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Run the sections over time; columns of ``x`` together."""
    out = np.empty_like(x)
    for i, row in enumerate(x):
        for s, (b0, b1, b2, _, a1, a2) in enumerate(sos):
            y = b0 * row + state[s, 0]
            state[s, 0] = b1 * row - a1 * y + state[s, 1]
            state[s, 1] = b2 * row - a2 * y
            row = y
        out[i] = row
    return out


def zero_phase(x: np.ndarray, sos: np.ndarray) -> np.ndarray:
    """Forward and backward filtering with odd extension and steady starts; (rows, columns)."""
    pad = 3 * (2 * len(sos) + 1)
    if len(x) <= pad:
        raise ValueError(f"needs more than {pad} rows")
    extended = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    steady = np.zeros((len(sos), 2))
    for s, (b0, b1, b2, _, a1, a2) in enumerate(sos):  # each section passes a constant unchanged
        steady[s] = (b1 - a1) + (b2 - a2), b2 - a2
        assert abs((b0 + b1 + b2) / (1 + a1 + a2) - 1) < 1e-9
    for _ in range(2):
        extended = _sections(sos, extended, steady[:, :, None] * extended[0])[::-1]
    return extended[pad:-pad]


def low_pass(df: DataFrame, cutoff_hz: float = 20.0, columns: tuple[str, ...] = tuple(GYRO + ACCEL), chunk_rows: int = 50_000, halo_rows: int = 400) -> DataFrame:
    """Zero-phase Butterworth of order 4 on each sequence.

    Filtering is sequential in time, so it runs in Python.  Long sequences are cut
    into chunks with a halo on both sides, beyond which the filter's memory has
    died out; each chunk is a group of its own, however long its sequence is.
    """
    rates = source_rate(df)
    numbered = df.join(rates, SEQUENCE).withColumn("__i", F.row_number().over(in_time()) - 1)
    chunk = F.floor(F.col("__i") / chunk_rows)
    lies_in = F.array_distinct(F.array(F.floor((F.col("__i") - halo_rows) / chunk_rows), chunk, F.floor((F.col("__i") + halo_rows) / chunk_rows)))
    kept = df.columns
    dealt = numbered.withColumn("__home", chunk).withColumn("__chunk", F.explode(F.filter(lies_in, lambda c: c >= 0)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TIME)
        own = pdf["__home"] == pdf["__chunk"]
        if not own.any():
            return pdf[own][kept]
        rate = float(pdf["source_rate_hz"].iloc[0])
        sos = butterworth_sos(4, min(cutoff_hz, 0.99 * rate / 2), rate)
        pdf[list(columns)] = zero_phase(pdf[list(columns)].to_numpy(float), sos)
        return pdf[own][kept]

    return dealt.groupBy(SEQUENCE, "__chunk").applyInPandas(run, df.schema)


def fir_weights(half: int, cutoff: float) -> list[float]:
    """Windowed-sinc low-pass, symmetric; ``cutoff`` as a share of the sample rate."""
    taps = [(2 * cutoff if i == 0 else math.sin(2 * math.pi * cutoff * i) / (math.pi * i)) * (0.5 + 0.5 * math.cos(math.pi * i / (half + 1))) for i in range(-half, half + 1)]
    return [t / sum(taps) for t in taps]


def low_pass_fir(df: DataFrame, columns: list[str], half: int = 8, cutoff: float = 0.1) -> DataFrame:
    """Zero-phase low-pass as a weighted sum over neighbours; ends repeat the end rows."""
    w, weights = in_time(), fir_weights(half, cutoff)
    all_rows = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def smooth(c: str):
        first, last = F.first(c).over(all_rows), F.last(c).over(all_rows)
        parts = []
        for i, t in zip(range(-half, half + 1), weights, strict=True):
            near = F.coalesce(F.lag(c, -i).over(w), first if i < 0 else last) if i else F.col(c)
            parts.append(near * t)
        return reduce(lambda a, b: a + b, parts)

    return df.withColumns({c: smooth(c) for c in columns})


def resample(df: DataFrame, step_ns: int = 20_000_000, cutoff_hz: float | None = 20.0) -> DataFrame:
    """Filter, repair quaternion signs, interpolate on the grid, renormalise, number."""
    filtered = low_pass(df, cutoff_hz) if cutoff_hz else df
    repaired = repair_quaternion_signs(filtered, QUATERNION)
    on_grid = renormalize(interpolate(uniform_grid(df, step_ns), repaired, QUATERNION + GYRO + ACCEL, clamp_ends=True))
    return on_grid.withColumn(STEP, (F.row_number().over(in_time()) - 1).cast("long"))
