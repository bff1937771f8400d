"""Many injection trials at once: a trial is a row, not a loop.

Each trial takes the rows around its event from its sequence by an equi-join on
row number, so work grows with trials times the length of an event's
surroundings, and all trials are injected, scored and judged by one plan.  Only
rows inside an event that read other rows are joined with them.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contracts import ACCEL, ADAPTIVE_ROWS, GYRO, RAW, SCORE_STRIDE, SEQUENCE, SEVERITY, STEP, TIME, WINDOW
from ..sources.scratch import materialize
from .evaluate import quiet_surroundings, spaced_out
from .inject import DROPOUT_PERIOD, DURATION, HARD_CLIP, JITTER, LAG_ROWS, LEAKAGE, ROTATION_DEG, TARGET, motion_gates, noise_table, robust_scales, warp_table

SEPARATOR = "#"


def quiet_placements(annotated: DataFrame, rows: DataFrame, kinds: list[str], count: int = 3, stride: int = SCORE_STRIDE, gap: int = 500) -> DataFrame:
    """(sequence, anomaly_type, placement_index, start_index): where each fault is best tried.

    ``annotated``: the clean score timeline with its alerts; ``rows``: row number and motion context.
    A start is one whose surroundings hold no alert and whose motion lets the fault be injected; of
    these the ones with the lowest scores that lie ``gap`` rows apart are chosen, best first.
    """
    lengths = rows.groupBy(SEQUENCE).agg(F.count(F.lit(1)).alias("n"))
    quiet = quiet_surroundings(annotated, lengths, sorted({DURATION[k] for k in kinds}), stride)
    motion = rows.select(SEQUENCE, F.col(STEP).cast("long").alias("start_index"), *(motion_gates(k).alias(f"fits_{k}") for k in kinds))
    # The starts are made from few rows by an explode, which the planner takes for few rows: it must not broadcast them.
    met = quiet.join(motion.hint("merge"), [SEQUENCE, "start_index"])
    named = F.array(*(F.when(F.col(f"fits_{k}"), F.struct(F.lit(k).alias("anomaly_type"), F.col(f"d{DURATION[k]}").alias("seen"))) for k in kinds))
    each = met.select(SEQUENCE, "start_index", F.explode(F.filter(named, lambda f: f["seen"].isNotNull())).alias("f"))
    candidates = materialize(each.select(SEQUENCE, "start_index", "f.anomaly_type", "f.seen.*"), "quiet-places")
    chosen = spaced_out(candidates, count, gap, [SEQUENCE, "anomaly_type"])
    return chosen.select(SEQUENCE, "anomaly_type", F.col("choice").alias("placement_index"), "start_index")


def trial_grid(placements: DataFrame, lengths: DataFrame, severities: list[str]) -> DataFrame:
    """(sequence, trial, kind, severity, group, placement, start, end): every severity at each placement."""
    of_kind = F.create_map(*(F.lit(x) for k, d in DURATION.items() for x in (k, d)))
    group = F.create_map(*(F.lit(x) for k, g in TARGET.items() for x in (k, g)))
    df = placements.join(lengths.select(SEQUENCE, "n"), SEQUENCE).withColumn("severity", F.explode(F.array(*map(F.lit, severities))))
    end = F.least(F.col("n") - 1, F.col("start_index") + of_kind[F.col("anomaly_type")] - 1).cast("long")
    trial = F.concat_ws("/", "anomaly_type", "placement_index", "severity")
    return df.withColumns({"trial": trial, "target_group": group[F.col("anomaly_type")], "end_index": end}).drop("n")


def _by(column: str, values: dict[str, float], otherwise=None) -> Column:
    out = F.lit(otherwise)
    for name, value in values.items():
        out = F.when(F.col(column) == name, F.lit(value)).otherwise(out)
    return out


def _edits(df: DataFrame, trials: DataFrame, warps: DataFrame) -> DataFrame:
    """(sequence, trial, step, read_<channel>...): what rows of frozen, stale, late or warped faults read instead of their own."""
    kind, k, start, step = F.col("anomaly_type"), F.col("k"), F.col("start_index"), F.col(STEP)
    reading = trials.where(kind.isin("accel_freeze", "gyro_freeze", "packet_dropout", "sensor_lag", "timestamp_jitter"))
    inside = reading.withColumn(STEP, F.explode(F.sequence("start_index", "end_index"))).withColumn("k", step - start)
    inside = inside.join(F.broadcast(warps), ["anomaly_type", "severity", "placement_index", "k"], "left")
    period = _by("severity", DROPOUT_PERIOD)
    b = F.floor(k / period)
    block = F.when(b % 2 == 1, b).otherwise(b - 1)
    stale = F.greatest(F.lit(0), start - 1)
    dropout = F.when(period.isNull(), stale).when(k % period == 0, step).when(block >= 0, start + period * block).otherwise(stale)
    source = F.when(kind.endswith("_freeze"), start).when(kind == "packet_dropout", dropout).when(kind == "sensor_lag", F.greatest(F.lit(0), step - _by("severity", LAG_ROWS))).otherwise(start + F.col("low"))
    out = inside.select(SEQUENCE, "trial", STEP, F.coalesce("part", F.lit(0.0)).alias("part"), source.cast("long").alias("source"))
    out = out.withColumn("after", F.when(F.col("part") > 0, F.col("source") + 1).otherwise(F.col("source")))
    for name in ("source", "after"):
        read = df.select(SEQUENCE, F.col(STEP).alias(name), *(F.col(c).alias(f"{name}_{c}") for c in RAW))
        out = out.join(read.hint("merge"), [SEQUENCE, name])
    return out.select(SEQUENCE, "trial", STEP, *((F.col(f"source_{c}") + (F.col(f"after_{c}") - F.col(f"source_{c}")) * F.col("part")).alias(f"read_{c}") for c in RAW))


def inject_trials(df: DataFrame, trials: DataFrame, seed: int = 0, placements: int = 3, margin: int = WINDOW + ADAPTIVE_ROWS) -> DataFrame:
    """Rows around each trial's event with its fault written in; the sequence's name becomes ``name#trial``.

    A placement draws its noise and its warps with ``seed`` plus its number, of 1 to ``placements``.
    """
    spark = df.sparkSession
    kind, k, rows = F.col("anomaly_type"), F.col("k"), F.col("end_index") - F.col("start_index") + 1
    start, step, seeds = F.col("start_index"), F.col(STEP), range(1, placements + 1)
    warps = [("timestamp_jitter", s, p, i, low, part) for s in JITTER for p in seeds for i, low, part in warp_table(s, seed + p, DURATION["timestamp_jitter"])]
    warp = spark.createDataFrame(warps, "anomaly_type string, severity string, placement_index int, k long, low long, part double")
    wide = trials.withColumn(STEP, F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), start - margin), F.col("end_index") + margin)))
    # Rows made by an explode of few rows: the planner takes them for few and would send them through the driver.
    base = wide.join(df.select(SEQUENCE, TIME, STEP, *RAW).hint("merge"), [SEQUENCE, STEP])
    base = base.withColumns({"k": step - start, "inside": step.between(start, F.col("end_index"))})
    base = base.join(_edits(df, trials, warp).hint("merge"), [SEQUENCE, "trial", STEP], "left")
    base = base.join(robust_scales(df, {"gyro": GYRO, "accel": ACCEL, "mixed": ACCEL + GYRO}), SEQUENCE)
    noise = [(p, i, *map(float, row)) for p in seeds for i, row in enumerate(noise_table(seed + p, DURATION["noise_burst"]))]
    table = spark.createDataFrame(noise, ", ".join(["placement_index int", "k long", *(f"noise_{c} double" for c in ACCEL + GYRO)]))
    base = base.join(F.broadcast(table), ["placement_index", "k"], "left")

    factor = _by("severity", SEVERITY)
    amount = {n: F.col(f"scale_{n}") * factor for n in ("gyro", "accel", "mixed")}
    ramp = F.when(rows > 1, k / F.greatest(rows - 1, F.lit(1))).otherwise(0.0)
    turn = _by("severity", {s: math.radians(d) for s, d in ROTATION_DEG.items()})
    wave = F.greatest(rows - 1, F.lit(1))
    clip = F.when(kind == "clipping", amount["accel"]).otherwise(F.col("scale_accel") * _by("severity", HARD_CLIP))

    def value(c: str) -> Column:
        x, group = F.col(c), "gyro" if c in GYRO else "accel" if c in ACCEL else "quaternion"
        read = F.col(f"read_{c}")
        cases: list[tuple[Column, Column]] = [(kind.isin("packet_dropout", "timestamp_jitter"), read)]
        if group != "quaternion":
            cases += [(kind == f"{group}_freeze", read), (kind == f"{group}_bias_drift", x + amount[group] * ramp), (kind == "noise_burst", x + amount["mixed"] * F.col(f"noise_{c}"))]
        if group == "gyro":
            cases.append((kind == "gyro_bias_step", x + amount["gyro"]))
        if group == "accel":
            i = ACCEL.index(c)
            cases += [(kind == "sensor_lag", read), (kind.isin("clipping", "hard_clipping"), F.greatest(-clip, F.least(clip, x))), (kind == "cross_axis_leakage", x + F.col(ACCEL[(i + 1) % 3]) * _by("severity", LEAKAGE))]
            if i < 2:
                a, b = F.col(ACCEL[0]), F.col(ACCEL[1])
                cases.append((kind == "gyro_accel_inconsistency", a * F.cos(turn) - b * F.sin(turn) if i == 0 else a * F.sin(turn) + b * F.cos(turn)))
        if c == ACCEL[2]:
            cases += [(kind == "impact_pulse", x + amount["accel"] * (0.5 - 0.5 * F.cos(2 * math.pi * (k + 1) / (rows + 1)))), (kind == "vibration_burst", x + amount["accel"] * F.sin(4 * math.pi * k / wave))]
        if c == GYRO[2]:
            cases.append((kind == "angular_rate_burst", x + amount["gyro"] * F.sin(2 * math.pi * k / wave)))
        return reduce(lambda out, case: F.when(F.col("inside") & case[0], case[1]).otherwise(out), cases, x)

    return base.select(F.concat_ws(SEPARATOR, SEQUENCE, "trial").alias(SEQUENCE), TIME, STEP, *(value(c).alias(c) for c in RAW))


def trial_events(trials: DataFrame) -> DataFrame:
    """The trials as events of their own sequences."""
    return trials.select(F.concat_ws(SEPARATOR, SEQUENCE, "trial").alias(SEQUENCE), F.lit(1).alias("event_order"), "anomaly_type", "severity", "target_group", "start_index", "end_index")
