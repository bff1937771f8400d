"""Synthetic faults, written into a span of rows.

Every fault is a projection over a span [start, end] of each sequence, or a
remapping of rows by an equi-join; afterwards derived features are worked out
anew if the table has them.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contracts import ACCEL, DERIVED, GYRO, RAW, SEQUENCE, SEVERITY, SPEED_GATE, STEP, VERTICAL_GATE, YAW_GATE
from ..functions.faults import FAULTS
from ..sources.scratch import materialize
from .derive import derive_imu_features
from .quantiles import exact_quantiles

#: Rows and target group of each fault. Fixed values.
DURATION = {
    "gyro_bias_step": 50, "gyro_bias_drift": 75, "accel_bias_drift": 75, "accel_freeze": 40, "gyro_freeze": 40, "noise_burst": 20,
    "clipping": 20, "hard_clipping": 20, "packet_dropout": 20, "sensor_lag": 40, "timestamp_jitter": 40, "cross_axis_leakage": 40,
    "gyro_accel_inconsistency": 40, "impact_pulse": 8, "vibration_burst": 20, "angular_rate_burst": 15,
}
TARGET = {
    "gyro_bias_step": "gyro", "gyro_bias_drift": "gyro", "accel_bias_drift": "accel", "accel_freeze": "accel", "gyro_freeze": "gyro", "noise_burst": "mixed",
    "clipping": "accel", "hard_clipping": "accel", "packet_dropout": "mixed", "sensor_lag": "accel", "timestamp_jitter": "mixed", "cross_axis_leakage": "accel",
    "gyro_accel_inconsistency": "accel", "impact_pulse": "accel", "vibration_burst": "accel", "angular_rate_burst": "gyro",
}
HARD_CLIP = {"small": 5.0, "medium": 3.0, "large": 1.5}
LAG_ROWS = {"small": 3, "medium": 8, "large": 15}
LEAKAGE = {"small": 0.15, "medium": 0.35, "large": 0.6}
ROTATION_DEG = {"small": 15.0, "medium": 35.0, "large": 60.0}
JITTER = {"small": 0.35, "medium": 0.75, "large": 1.5}
DROPOUT_PERIOD = {"small": 4, "medium": 2}
#: Column with the row at which a sequence's fault begins.
START = "__start"
NEEDS_SPEED, NEEDS_TURN = ("impact_pulse", "vibration_burst"), ("angular_rate_burst",)


def robust_scales(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(sequence, scale_<group>...): median distance to the median, over all columns of a group together; tiny ones count as 1.

    All groups go through the same two passes.
    """
    of = {c: [g for g, columns in groups.items() if c in columns] for c in dict.fromkeys(c for columns in groups.values() for c in columns)}
    cells = F.array(*(F.struct(F.lit(g).alias("g"), F.col(c).alias("x")) for c, gs in of.items() for g in gs))
    long = df.select(SEQUENCE, F.explode(cells).alias("cell")).select(SEQUENCE, "cell.*")
    # Written, a few rows a sequence: their size is known, so values are not shuffled for them.
    middle = materialize(exact_quantiles(long, [SEQUENCE, "g"], "x", [0.5]).select(SEQUENCE, "g", F.col("q")[0].alias("m")), "middles")
    far = long.join(middle, [SEQUENCE, "g"]).withColumn("away", F.abs(F.col("x") - F.col("m")))
    far = exact_quantiles(far, [SEQUENCE, "g"], "away", [0.5]).select(SEQUENCE, "g", F.col("q")[0].alias("scale"))
    scale = F.when(F.col("scale") <= 1e-6, 1.0).otherwise(F.col("scale"))
    return far.groupBy(SEQUENCE).agg(*(F.max(F.when(F.col("g") == g, scale)).alias(f"scale_{g}") for g in groups))


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(sequence, scale) of one group of columns."""
    return robust_scales(df, {"all": columns}).withColumnRenamed("scale_all", "scale")


def motion_gates(kind: str, active_run: bool = True) -> Column:
    """Whether the motion at a row lets a fault of this kind be injected."""
    speed, vertical, turn = F.col("gt_speed_mps") > SPEED_GATE, F.abs("gt_vertical_speed_mps") > VERTICAL_GATE, F.abs("gt_yaw_rate_rps") > YAW_GATE
    rule = F.lit(True)
    if kind in NEEDS_SPEED:
        rule = speed | vertical
    elif kind in ("angular_rate_burst", "sensor_lag", "gyro_accel_inconsistency"):
        rule = speed | turn
    return F.coalesce((speed | vertical | turn) & rule if active_run else rule, F.lit(False))


def with_context(df: DataFrame) -> DataFrame:
    """Motion context, constant where the table has none."""
    defaults = {"gt_speed_mps": 1.0, "gt_vertical_speed_mps": 0.1, "gt_yaw_rate_rps": 0.2}
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def require_motion(df: DataFrame, kind: str, start: int) -> None:
    """Raise if the motion at ``start`` does not allow the fault; looks at one row a sequence."""
    if kind in NEEDS_SPEED + NEEDS_TURN and not with_context(df).where((F.col(STEP) == start) & ~motion_gates(kind, active_run=False)).isEmpty():
        raise ValueError(f"{kind} needs motion at row {start}")


def start_row(length: Column, duration: int, window: int) -> Column:
    """Where a fault of some duration begins in a sequence of ``length`` rows."""
    upper = length - duration - 1
    return F.greatest(F.lit(0), F.least(upper, F.lit(window + 10)))


def warp_table(severity: str, seed: int, rows: int) -> list[tuple[int, int, float]]:
    """(offset, segment, part): where each row of a jittered span is read from."""
    rng = np.random.default_rng(seed)
    steps = np.clip(1 + rng.normal(0, JITTER[severity], rows), 0.2, 2.5)
    at = np.cumsum(steps)
    at = (at - at[0]) / max(at[-1] - at[0], 1e-12) * (rows - 1)
    read = np.interp(np.arange(rows), at, np.arange(rows))
    low = np.minimum(np.floor(read).astype(int), max(rows - 2, 0))
    return [(int(k), int(i), float(x - i)) for k, (i, x) in enumerate(zip(low, read, strict=True))]


def noise_table(seed: int, rows: int) -> np.ndarray:
    """Standard normal draws, accel axes first; (rows, 6)."""
    return np.random.default_rng(seed).normal(0.0, 1.0, (rows, 6))


def inject(df: DataFrame, kind: str, severity: str, start: int, seed: int = 0) -> DataFrame:
    """Write one fault into every sequence, from row ``start``."""
    require_motion(df, kind, start)
    return inject_at(df.withColumn(START, F.lit(start).cast("long")), kind, severity, seed).drop(START)


def inject_in_turn(df: DataFrame, events: DataFrame, plan: list[tuple[str, str]], seed: int = 0) -> DataFrame:
    """Write a plan's faults one after the other; each reads, and takes its scale from, what those before have written.

    ``events``: sequence, event_order (1 for the plan's first fault) and start_index; a sequence without
    an event is left as it is.  Starts come to the rows by one join; every fault is one more projection of
    the same plan, with a join for what it reads from elsewhere in the sequence.  Rows are never
    rewritten: only a fault's scales, a number a sequence, are worked out and written before the next one.
    """
    names = [f"__start{k}" for k in range(1, len(plan) + 1)]
    # Written, a row a sequence, so that rows are not shuffled for them nor faults worked out again.
    last = materialize(df.groupBy(SEQUENCE).agg(F.max(STEP).alias("__last")), "lengths")
    starts = events.groupBy(SEQUENCE).agg(*(F.max(F.when(F.col("event_order") == k, F.col("start_index"))).alias(n) for k, n in enumerate(names, 1)))
    out = df.join(materialize(starts, "starts"), SEQUENCE, "left")
    for k, (kind, severity) in enumerate(plan):
        out = inject_at(out.withColumn(START, F.col(names[k])), kind, severity, seed + k, lambda scale: materialize(scale, "scale"), last)
    return out.select(*df.columns)


def inject_at(df: DataFrame, kind: str, severity: str, seed: int = 0, keep=lambda scale: scale, last: DataFrame | None = None) -> DataFrame:
    """Write one fault into each sequence, from the row that its column START names; null: nowhere.

    ``keep`` may write the scales, so that they are worked out once; ``last`` has each sequence's last row number, where it is known.
    """
    if kind not in DURATION:
        raise ValueError(f"unknown fault: {kind}")
    if severity not in SEVERITY:
        raise ValueError(f"unknown severity: {severity}")
    columns = df.columns
    i, start, spark = F.col(STEP), F.col(START), df.sparkSession
    df = df.join(df.groupBy(SEQUENCE).agg(F.max(STEP).alias("__last")) if last is None else last, SEQUENCE)
    end = F.least(F.col("__last"), start + (DURATION[kind] - 1))
    inside, offset, rows = (i >= start) & (i <= end), i - start, end - start + 1
    group = {"gyro": GYRO, "accel": ACCEL}.get(TARGET[kind], ACCEL + GYRO)

    def change(values: dict[str, Column], table: DataFrame = df) -> DataFrame:
        return table.withColumns({c: F.when(inside, v).otherwise(F.col(c)) for c, v in values.items()})

    def scaled(columns: list[str]) -> DataFrame:
        return df.join(keep(robust_scale(df.select(SEQUENCE, *columns), columns)), SEQUENCE)

    def by_offset(rows: list[tuple], schema: str) -> DataFrame:
        """A short table of a fault's rows, by their offset from its start."""
        return df.withColumn("__k", offset).join(F.broadcast(spark.createDataFrame(rows, f"__k long, {schema}")), "__k", "left")

    amount = F.col("scale") * SEVERITY[severity]
    if kind == "gyro_bias_step":
        out = change({c: F.col(c) + amount for c in GYRO}, scaled(GYRO))
    elif kind in ("gyro_bias_drift", "accel_bias_drift"):
        ramp = F.when(rows > 1, offset / F.greatest(rows - 1, F.lit(1))).otherwise(0.0)
        out = change({c: F.col(c) + amount * ramp for c in group}, scaled(group))
    elif kind in ("accel_freeze", "gyro_freeze"):
        out = _read_from(df, F.when(inside, start).otherwise(i), group)
    elif kind == "noise_burst":
        draws = noise_table(seed, DURATION[kind])
        df = by_offset([(k, *map(float, row)) for k, row in enumerate(draws)], ", ".join(f"__n{j} double" for j in range(6)))
        out = change({c: F.col(c) + amount * F.col(f"__n{j}") for j, c in enumerate(ACCEL + GYRO)}, scaled(ACCEL + GYRO))
    elif kind in ("clipping", "hard_clipping"):
        limit = amount if kind == "clipping" else F.col("scale") * HARD_CLIP[severity]
        out = change({c: F.greatest(-limit, F.least(limit, F.col(c))) for c in ACCEL}, scaled(ACCEL))
    elif kind == "packet_dropout":
        stale = F.greatest(F.lit(0), start - 1)
        if severity in DROPOUT_PERIOD:
            period = DROPOUT_PERIOD[severity]
            b = F.floor(offset / period)
            a = F.when(offset % period == 0, None).when(b % 2 == 1, b).otherwise(b - 1)
            source = F.when(offset % period == 0, i).when(a >= 0, start + period * a).otherwise(stale)
        else:
            source = stale
        out = _read_from(df, F.when(inside, source).otherwise(i), RAW)
    elif kind == "sensor_lag":
        out = _read_from(df, F.when(inside, F.greatest(F.lit(0), i - LAG_ROWS[severity])).otherwise(i), ACCEL)
    elif kind == "timestamp_jitter":
        warped = by_offset(warp_table(severity, seed, DURATION[kind]), "__low long, __part double")
        source = F.when(inside, start + F.col("__low"))
        low = _read_from(warped, F.coalesce(source, i), RAW, "__a_")
        both = _read_from(low, F.coalesce(source + 1, i), RAW, "__b_", df)
        out = change({c: F.col(f"__a_{c}") + (F.col(f"__b_{c}") - F.col(f"__a_{c}")) * F.col("__part") for c in RAW}, both)
    elif kind == "cross_axis_leakage":
        share = LEAKAGE[severity]
        out = change({c: F.col(c) + F.col(other) * share for c, other in zip(ACCEL, ACCEL[1:] + ACCEL[:1], strict=True)})
    elif kind == "gyro_accel_inconsistency":
        turn, (x, y) = math.radians(ROTATION_DEG[severity]), ACCEL[:2]
        out = change({x: F.col(x) * math.cos(turn) - F.col(y) * math.sin(turn), y: F.col(x) * math.sin(turn) + F.col(y) * math.cos(turn)})
    elif kind == "impact_pulse":
        out = change({ACCEL[2]: F.col(ACCEL[2]) + amount * (0.5 - 0.5 * F.cos(2 * math.pi * (offset + 1) / (rows + 1)))}, scaled(ACCEL))
    elif kind == "vibration_burst":
        out = change({ACCEL[2]: F.col(ACCEL[2]) + amount * F.sin(4 * math.pi * offset / F.greatest(rows - 1, F.lit(1)))}, scaled(ACCEL))
    else:
        out = change({GYRO[2]: F.col(GYRO[2]) + amount * F.sin(2 * math.pi * offset / F.greatest(rows - 1, F.lit(1)))}, scaled(GYRO))
    out = out.select(*columns)
    return derive_imu_features(out).select(*columns) if set(DERIVED) <= set(columns) else out


def _read_from(df: DataFrame, source: Column, columns: list[str], prefix: str = "", table: DataFrame | None = None) -> DataFrame:
    """Take columns from the row of the same sequence that ``source`` numbers."""
    wanted = df.withColumn("__source", source.cast("long"))
    rows = (df if table is None else table).select(SEQUENCE, F.col(STEP).cast("long").alias("__source"), *(F.col(c).alias(f"__read_{c}") for c in columns))
    joined = wanted.join(rows, [SEQUENCE, "__source"])
    return joined.withColumns({f"{prefix}{c}": F.col(f"__read_{c}") for c in columns}).drop("__source", *(f"__read_{c}" for c in columns))


def demo_schedule(lengths: DataFrame, plan: list[tuple[str, str]], window: int) -> DataFrame:
    """Starts of a few faults, evenly spread inside each sequence that is long enough."""
    low, high = F.lit(window + 50), F.col("n") - 51
    rows = []
    for k, (kind, severity) in enumerate(plan, 1):
        anchor = F.floor(low + (high - low) * (k / (len(plan) + 1)))
        start = F.least(F.greatest(low, anchor), F.greatest(low, high - DURATION[kind]))
        rows.append(F.struct(F.lit(k).alias("event_order"), F.lit(kind).alias("anomaly_type"), F.lit(severity).alias("severity"), F.lit(TARGET[kind]).alias("target_group"), start.cast("long").alias("start_index"), (start + DURATION[kind] - 1).cast("long").alias("end_index")))
    long_enough = lengths.where(F.col("n") - 1 > window + 100)
    return long_enough.select(SEQUENCE, F.explode(F.array(*rows)).alias("e")).select(SEQUENCE, "e.*")


def catalog(spark) -> DataFrame:
    """All faults, made and planned; rows and whether they need motion of those that can be injected."""
    made = lambda kind, tier: tier != "planned" and kind in DURATION
    rows = [(k, tier, group, method, DURATION[k] if made(k, tier) else None, k in NEEDS_SPEED + NEEDS_TURN if made(k, tier) else None) for k, tier, group, method in FAULTS]
    return spark.createDataFrame(rows, "anomaly_type string, tier string, target_group string, injection_method string, duration_rows int, needs_motion boolean")
