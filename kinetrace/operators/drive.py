"""Drive interface: odometry, commands, phases and speed calibration."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp, yaw
from ..sources.scratch import materialize
from . import blocks

#: Metres a second for one raw unit of speed. Fixed value.
VISUAL_MPS_PER_RAW = 0.44631542573761773


def normalize_odometry(odom: DataFrame) -> DataFrame:
    """Turn the heading by half a turn and negate planar speed; the rest stays."""
    turned = yaw("q_x", "q_y", "q_z", "q_w") + math.pi
    return odom.withColumn("__yaw", turned).withColumns({"q_x": F.lit(0.0), "q_y": F.lit(0.0), "q_z": F.sin(F.col("__yaw") / 2), "q_w": F.cos(F.col("__yaw") / 2), "vx": -F.col("vx"), "vy": -F.col("vy")}).drop("__yaw")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, columns: list[str]) -> DataFrame:
    """The last row of ``right`` at or before each row of ``left``, by one sort of both."""
    cell = F.struct(*columns)
    empty = F.lit(None).cast(right.select(cell.alias("c")).schema["c"].dataType)
    row = F.struct(*left.columns)
    none = F.lit(None).cast(left.select(row.alias("r")).schema["r"].dataType)
    both = left.select(key, time, F.lit(1).alias("side"), row.alias("row"), empty.alias("c")).unionByName(right.select(key, time, F.lit(0).alias("side"), none.alias("row"), cell.alias("c")))
    w = Window.partitionBy(key).orderBy(time).rangeBetween(Window.unboundedPreceding, 0)
    latest = both.withColumn("latest", F.last("c", ignorenulls=True).over(w)).where("side = 1")
    return latest.select("row.*", *(F.col(f"latest.{c}").alias(c) for c in columns))


def label_phases(rows: DataFrame, phases: DataFrame, time: str = "t") -> DataFrame:
    """The phase (name, start, end) in which each row lies; a schedule is short."""
    return rows.join(F.broadcast(phases), (F.col(time) >= F.col("phase_start")) & (F.col(time) < F.col("phase_end")), "left").drop("phase_start", "phase_end")


def phase_speed_metrics(rows: DataFrame, key: str = "phase", time: str = "t", least_rows: int = 3) -> DataFrame:
    """Displacement, chord speed, step speeds, lateral deviation of each phase.

    Rows have ``key``, ``time``, x, y, vx, vy, yaw; order is by time.
    """
    w = Window.partitionBy(key).orderBy(time)
    dt = F.col(time) - F.lag(time).over(w)
    speed = F.when(dt > 1e-9, F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) / dt)
    ends = rows.groupBy(key).agg(*(f(c, time).alias(f"{c}{n}") for n, f in ((0, F.min_by), (1, F.max_by)) for c in ("x", "y", "yaw")), F.min(time).alias("t0"), F.max(time).alias("t1"), F.count(F.lit(1)).alias("sample_count"))
    ends = ends.where(F.col("sample_count") >= least_rows).withColumns({"duration_s": F.greatest(F.col("t1") - F.col("t0"), F.lit(1e-9)), "displacement_m": F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))})
    df = rows.withColumn("speed", speed).join(ends.drop("sample_count"), key)
    across = (-(F.col("x") - F.col("x0")) * (F.col("y1") - F.col("y0")) + (F.col("y") - F.col("y0")) * (F.col("x1") - F.col("x0"))) / F.greatest("displacement_m", F.lit(1e-300))
    lateral = F.when(F.col("displacement_m") > 1e-9, F.abs(across)).otherwise(0.0)
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.first("duration_s").alias("duration_s"),
        F.first("displacement_m").alias("displacement_m"),
        F.first(F.col("displacement_m") / F.col("duration_s")).alias("chord_speed_mps"),
        F.coalesce(F.avg("speed"), F.lit(0.0)).alias("pose_speed_mean_mps"),
        F.coalesce(F.percentile("speed", 0.5), F.lit(0.0)).alias("pose_speed_p50_mps"),
        F.coalesce(F.percentile("speed", 0.95), F.lit(0.0)).alias("pose_speed_p95_mps"),
        F.avg(-F.col("vx")).alias("twist_visual_speed_mean_mps"),
        F.avg(F.hypot("vx", "vy")).alias("twist_norm_speed_mean_mps"),
        F.max(lateral).alias("max_abs_lateral_deviation_m"),
        F.first(F.degrees(F.col("yaw1") - F.col("yaw0"))).alias("yaw_change_deg"),
    )


def speed_fit(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Least squares line, its R squared, and the slope through the origin."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    through = F.try_divide(F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x)))
    return df.groupBy(*(by or [])).agg(zero(F.regr_slope(y, x)).alias("slope"), zero(F.regr_intercept(y, x)).alias("intercept"), zero(F.regr_r2(y, x)).alias("r2"), zero(through).alias("slope_through_origin"), F.count(F.lit(1)).alias("point_count"))


def drive_summary(rows: DataFrame, by: str, time: str = "t", straight: str = "A", arc: str = "N", stop: str = "R") -> DataFrame:
    """Displacements and speeds of a run by the phases it went through."""
    moving = F.abs("cmd_speed") > 1e-6
    out = []
    for name, chosen in (("moving", moving), ("straight", F.col("phase") == straight), ("arc", F.col("phase") == arc)):
        at = F.when(chosen, F.col(time))
        ends = [f(F.when(chosen, F.col(c)), at) for f in (F.max_by, F.min_by) for c in ("x", "y")]
        out.append(F.when(F.count_if(chosen) >= 2, F.hypot(ends[0] - ends[2], ends[1] - ends[3])).otherwise(0.0).alias(f"{name}_displacement_m"))
    speed = F.hypot("vx", "vy")
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("row_count"),
        *out,
        F.coalesce(F.avg(F.when(moving, -F.col("vx"))), F.lit(0.0)).alias("moving_visual_speed_mean_mps"),
        F.coalesce(F.percentile(F.when(moving, speed), 0.95), F.lit(0.0)).alias("moving_norm_speed_p95_mps"),
        F.coalesce(F.avg(F.when(F.col("phase") == stop, speed)), F.lit(0.0)).alias("final_stop_norm_mean_mps"),
    )


#: Columns of the control log. TICK_MS: 20 ticks a second; HOLD_MS: ticks pause when nothing has been heard for so long.
TICK_LOG = ["desired_speed", "actual_visual_speed", "speed_error", "desired_steer", "desired_acceleration", "feedforward_raw_speed", "feedback_raw_speed", "raw_speed", "raw_steer", "raw_acceleration"]
TICK_MS, HOLD_MS = 50, 1000


@dataclass
class CommandShim:
    """Speed control with feed-forward and a PI term; one call per timer tick. ``feedback`` is pi or off."""

    timeout_s: float = 0.5
    deadband: float = 1e-3
    kp: float = 0.6
    ki: float = 0.15
    integral_limit: float = 1.0
    max_speed: float = 2.0
    max_steer: float = 0.6
    max_acceleration: float = 3.0
    sign: float = -1.0
    feedback: str = "pi"
    integral: float = 0.0

    def log(self, dt: float, age: float, speed: float, steer: float, acceleration: float, actual: float) -> tuple[float, ...]:
        """What a tick does, as TICK_LOG; a stale command counts as a stop."""
        limit = lambda v, most: max(-most, min(most, v))
        if age > self.timeout_s:
            speed = steer = acceleration = 0.0
        error, forward, back, raw = speed - actual, 0.0, 0.0, 0.0
        if abs(speed) < self.deadband or self.feedback != "pi":
            self.integral = 0.0
        else:
            self.integral = limit(self.integral + error * dt, self.integral_limit)
            back = self.kp * error + self.ki * self.integral
        if abs(speed) >= self.deadband:
            forward = speed / VISUAL_MPS_PER_RAW
            raw = self.sign * limit(forward + back, self.max_speed)
        return speed, actual, error, steer, acceleration, forward, back, raw, limit(steer, self.max_steer), self.sign * limit(acceleration, self.max_acceleration)

    def logs(self, dt: np.ndarray, age: np.ndarray, speed: np.ndarray, steer: np.ndarray, acceleration: np.ndarray, actual: np.ndarray) -> list[np.ndarray]:
        """``log`` of many ticks at once; only the integral goes on from one to the next.  An age that is NaN is stale."""
        fresh, most = age <= self.timeout_s, self.integral_limit
        speed, steer, acceleration = (np.where(fresh, v, 0.0) for v in (speed, steer, acceleration))
        error, stopped = speed - actual, np.abs(speed) < self.deadband
        off, integral, sums = stopped | (self.feedback != "pi"), self.integral, []
        for step, anew in zip((error * dt).tolist(), off.tolist(), strict=True):
            integral = 0.0 if anew else max(-most, min(most, integral + step))
            sums.append(integral)
        self.integral = integral
        back = np.where(off, 0.0, self.kp * error + self.ki * np.array(sums, dtype=float))
        forward = np.where(stopped, 0.0, speed / VISUAL_MPS_PER_RAW)
        raw = np.where(stopped, 0.0, self.sign * np.clip(forward + back, -self.max_speed, self.max_speed))
        return [speed, actual, error, steer, acceleration, forward, back, raw, np.clip(steer, -self.max_steer, self.max_steer), self.sign * np.clip(acceleration, -self.max_acceleration, self.max_acceleration)]

    def tick(self, *reading: float) -> tuple[float, float, float]:
        """Raw speed, steering and acceleration."""
        return self.log(*reading)[-3:]


def _of_parts(df: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """A row for each key and part of time, written."""
    return materialize(df.groupBy(key, blocks.PART).agg(*(v.alias(n) for n, v in values.items())), "parts")


def _earlier(key: str, column: str) -> Column:
    """The last value that is not null in the parts before."""
    return F.last(column, ignorenulls=True).over(Window.partitionBy(key).orderBy(blocks.PART).rowsBetween(Window.unboundedPreceding, -1))


def controlled(ticks: DataFrame, key: str, time: str, **settings) -> DataFrame:
    """TICK_LOG of ticks (key, time, dt, age, speed, steer, acceleration, actual); a null age is stale.

    Only the integral depends on ticks before, and it starts anew at every stop.  So
    ticks are parted at stops, and a task carries the integral through the rows of its
    parts as they come, whatever their number.  Stops are looked for in parts of time where ticks have them (PART).
    """
    s = CommandShim(**settings)
    stale = F.coalesce(F.col("age") > s.timeout_s, F.lit(True))
    df = ticks.withColumns({n: F.when(stale, 0.0).otherwise(F.col(c)) for n, c in (("desired_speed", "speed"), ("desired_steer", "steer"), ("desired_acceleration", "acceleration"))})
    stopped = F.abs("desired_speed") < s.deadband
    df = df.withColumns({"speed_error": F.col("desired_speed") - F.col("actual"), "_stopped": stopped})
    if blocks.PART in df.columns:
        # Runs are named by the stop that they follow; a part gets the last one of the parts before.
        before = _of_parts(df, key, {"_stop": F.max(F.when(F.col("_stopped"), F.col(time)))}).select(key, blocks.PART, _earlier(key, "_stop").alias("_stop"))
        w = Window.partitionBy(key, blocks.PART).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
        last = F.last(F.when(F.col("_stopped"), F.col(time)), ignorenulls=True).over(w)
        df = df.join(before, [key, blocks.PART]).withColumn("_part", F.coalesce(last, "_stop", F.lit(-1))).drop("_stop", blocks.PART)
    else:
        df = df.withColumn("_part", F.sum(F.col("_stopped").cast("long")).over(Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_step", F.when(stopped, None).otherwise(F.col("speed_error") * F.col("dt")))

    def run(frames):
        part, integral = None, 0.0
        for pdf in frames:
            out = []
            for name, number, step in zip(pdf[key], pdf["_part"], pdf["_step"], strict=True):
                if (name, number) != part:
                    part, integral = (name, number), 0.0
                if step == step and step is not None:
                    integral = max(-s.integral_limit, min(s.integral_limit, integral + step))
                out.append(integral)
            yield pdf.assign(_integral=out)

    if s.feedback == "pi":
        schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", _integral double"
        df = df.repartition(key, "_part").sortWithinPartitions(key, "_part", time).mapInPandas(run, schema)
        back = s.kp * F.col("speed_error") + s.ki * F.col("_integral")
    else:
        back = F.lit(0.0)
    forward = F.col("desired_speed") / VISUAL_MPS_PER_RAW
    moving = lambda c: F.when(F.col("_stopped"), 0.0).otherwise(c)
    logged = {
        "actual_visual_speed": F.col("actual"),
        "feedforward_raw_speed": moving(forward),
        "feedback_raw_speed": moving(back),
        "raw_speed": moving(s.sign * clamp(forward + back, s.max_speed)),
        "raw_steer": clamp(F.col("desired_steer"), s.max_steer),
        "raw_acceleration": s.sign * clamp(F.col("desired_acceleration"), s.max_acceleration),
    }
    return df.withColumns(logged).drop("_stopped", "_part", "_step", "_integral")


def run_shim(ticks: DataFrame, key: str, **settings) -> DataFrame:
    """Control outputs for ticks (key, t, age, speed, steer, acceleration, vx)."""
    dt = F.coalesce(F.greatest(F.col("t") - F.lag("t").over(Window.partitionBy(key).orderBy("t")), F.lit(1e-6)), F.lit(1e-6))
    read = ticks.withColumns({"dt": dt, "actual": -F.col("vx")})
    return controlled(read, key, "t", **settings).select(key, "t", "raw_speed", "raw_steer", "raw_acceleration")


def control_ticks(records: DataFrame, key: str, **settings) -> DataFrame:
    """Control log of commands and odometry (key, at_ms, kind, speed, steer, acceleration, vx), as the live operator makes it.

    Ticks lie on a grid of TICK_MS from a robot's first record.  Each record makes the ticks up to
    the next one, at most those of HOLD_MS, with what is newest then; so there is no
    tick in a pause.  Records go in parts of time, so no task sorts a robot's whole log.  Of several records of a kind at one time the largest counts.
    """
    command, odometry = F.col("kind") == "command", F.col("kind") == "odometry"
    at = records.groupBy(key, "at_ms").agg(F.max(F.when(command, F.struct("at_ms", "speed", "steer", "acceleration"))).alias("c"), F.max(F.when(odometry, F.struct("at_ms", "vx"))).alias("o"))
    parted = blocks.by_time(materialize(at, "records"), "at_ms")
    # What a part takes from the others: the newest of each kind before it, the next record behind it, and the robot's first.
    ends = _of_parts(parted, key, {"c1": F.max("c"), "o1": F.max("o"), "a": F.min("at_ms")})
    parts = Window.partitionBy(key).orderBy(blocks.PART)
    ends = ends.select(key, blocks.PART, _earlier(key, "c1").alias("c0"), _earlier(key, "o1").alias("o0"), F.first("a").over(parts).alias("t0"), F.lead("a").over(parts).alias("behind"))
    w = Window.partitionBy(key, blocks.PART).orderBy("at_ms")
    newest = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), f"{c}0")
    now = parted.join(ends, [key, blocks.PART]).withColumns({"c": newest("c"), "o": newest("o"), "next": F.coalesce(F.lead("at_ms").over(w), "behind")})
    first = F.ceil((F.col("at_ms") - F.col("t0")) / TICK_MS)
    last = F.floor((F.least(F.col("next") - 1, F.col("at_ms") + HOLD_MS) - F.col("t0")) / TICK_MS)
    now = materialize(now.select(key, blocks.PART, "c", "o", "t0", first.alias("n0"), last.alias("n1")).where("n1 >= n0"), "records-with-ticks")
    before = _of_parts(now, key, {"_tick": F.max(F.col("t0") + F.col("n1") * TICK_MS)}).select(key, blocks.PART, _earlier(key, "_tick").alias("_tick"))
    ticks = now.join(before, [key, blocks.PART]).withColumn("n", F.explode(F.sequence("n0", "n1"))).withColumn("tick_ms", F.col("t0") + F.col("n") * TICK_MS)
    earlier = F.coalesce(F.lag("tick_ms").over(Window.partitionBy(key, blocks.PART).orderBy("tick_ms")), "_tick")
    dt = F.greatest((F.col("tick_ms") - earlier) / 1000, F.lit(1e-6))
    read = ticks.select(key, blocks.PART, "tick_ms", F.coalesce(dt, F.lit(1e-6)).alias("dt"), ((F.col("tick_ms") - F.col("c.at_ms")) / 1000).alias("age"), *(F.coalesce(f"c.{n}", F.lit(0.0)).alias(n) for n in ("speed", "steer", "acceleration")), (-F.coalesce("o.vx", F.lit(0.0))).alias("actual"))
    return controlled(read, key, "tick_ms", **settings).select(key, "tick_ms", *TICK_LOG, F.col("age").alias("command_age_s"))


def gate_opens(rows: DataFrame, key: str, time: str, ready: Column, hold_s: float) -> DataFrame:
    """(key, opened): the first time at which ``ready`` has held for ``hold_s`` without a break."""
    flagged = rows.select(key, F.col(time).alias("_t"), F.coalesce(ready, F.lit(False)).alias("_ready"))
    w = Window.partitionBy(key, blocks.PART).orderBy("_t")
    # Runs are parted by time: a part begins with the row before it, and with the start of what holds there.
    parted = blocks.by_time(flagged, "_t")
    before = blocks.carried(parted, [key], F.struct("_t", "_ready"), F.col("_t")).select(key, blocks.PART, "c.*", F.lit(True).alias("_copy"))
    both = parted.withColumn("_copy", F.lit(False)).unionByName(before)
    begins = F.when(F.col("_ready") & ~F.coalesce(F.lag("_ready").over(w), F.lit(False)), F.col("_t"))
    begun = both.withColumn("_begin", begins).where("not _copy")
    since = blocks.carried(begun, [key], F.col("_begin"), F.col("_begin")).select(key, blocks.PART, F.col("c").alias("_begin"), F.lit(True).alias("_copy"))
    latest = F.last("_begin", ignorenulls=True).over(Window.partitionBy(key, blocks.PART).orderBy(F.desc("_copy"), "_t").rowsBetween(Window.unboundedPreceding, 0))
    held = begun.unionByName(since, allowMissingColumns=True).withColumn("_since", latest).where("not _copy and _ready")
    return held.where(F.col("_t") - F.col("_since") >= hold_s).groupBy(key).agg(F.min("_t").alias("opened"))


def phase_schedule(rows: DataFrame, key: str, time: str, ready: Column, hold_s: float, plan: list[tuple[str, float, dict[str, float]]], before: str = "startup", after: str = "done") -> DataFrame:
    """Rows with the phase of a plan in which they lie, the command given then, and the phase's start.

    ``plan``: (name, seconds, command).  Phases follow each other from the moment the gate opens;
    the first command also holds before, the last one after.  A run whose gate never opens stays in ``before``.
    """
    names, deadlines = list(plan[0][2]), [sum(p[1] for p in plan[: k + 1]) for k in range(len(plan))]
    t = F.col(time) - F.col("opened")
    # Written, a row a run: its size is known, so rows are not sorted by run for it.
    found = rows.join(materialize(gate_opens(rows, key, time, ready, hold_s), "gates"), key, "left")
    steps = [(before, plan[0][2], None, t < 0), *((name, command, end - seconds, t < end) for (name, seconds, command), end in zip(plan, deadlines, strict=True))]

    def chosen(value):
        out = F.lit(value(after, plan[-1][2], deadlines[-1]))
        for name, command, begin, within in reversed(steps):
            out = F.when(within, F.lit(value(name, command, begin))).otherwise(out)
        return F.when(F.col("opened").isNull(), F.lit(value(before, plan[0][2], None))).otherwise(out)

    begin = chosen(lambda n, c, b: b).cast("double")
    return found.withColumns({"phase_name": chosen(lambda n, c, b: n), **{f"cmd_{c}": chosen(lambda n, command, b, c=c: float(command[c])) for c in names}, "phase_start": F.col("opened") + begin}).drop("opened")


def nearest(asked: DataFrame, rows: DataFrame, key: str, time: str, columns: list[str]) -> DataFrame:
    """``asked`` (key, ``at``, ...) with the row of ``rows`` nearest in time; the earlier of equally near ones, the first of equal times.

    One sort of both by time: a row brings along the one that follows it, so the last row met
    at or before a moment knows both neighbours.
    """
    cell = F.struct(F.col(time).alias("t"), *columns)
    single = rows.groupBy(key, time).agg(F.min(F.struct(*columns)).alias("c")).select(key, time, *(F.col(f"c.{c}").alias(c) for c in columns))
    w = Window.partitionBy(key).orderBy(time)
    pairs = single.select(key, F.col(time).alias("_t"), F.struct(cell.alias("here"), F.lead(cell).over(w).alias("there")).alias("pair"))
    row = F.struct(*asked.columns)
    empty = lambda c, of: F.lit(None).cast(of.select(c).schema[0].dataType)
    both = pairs.select(key, "_t", "pair", empty(row, asked).alias("row")).unionByName(asked.select(key, F.col("at").alias("_t"), empty("pair", pairs).alias("pair"), row.alias("row")))
    order = Window.partitionBy(key).orderBy("_t", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("pair", F.last("pair", ignorenulls=True).over(order)).where("row is not null")
    # Before its first row, a key's nearest row is the first.
    firsts = rows.groupBy(key).agg(F.min(F.struct(F.col(time).alias("t"), *columns)).alias("first"))
    met = met.join(firsts, key, "left")
    here, there = F.col("pair.here"), F.col("pair.there")
    at = F.col("row.at")
    later = there.isNotNull() & (F.abs(there["t"] - at) < F.abs(here["t"] - at))
    return met.withColumn("hit", F.when(here.isNull(), F.col("first")).when(later, there).otherwise(here)).select("row.*", F.col("hit.t").alias(time), *(F.col(f"hit.{c}").alias(c) for c in columns))


def playheads(timeline: DataFrame, key: str, time: str, interval_s: float, speeds: list[int]) -> DataFrame:
    """(key, speed, tick, at): where a playhead stands at each tick of the wall clock, for each speed, from the first row to the last."""
    spans = timeline.groupBy(key).agg(F.min(time).alias("a"), F.max(time).alias("b"))
    step = F.lit(interval_s) * F.col("speed")
    each = spans.withColumn("speed", F.explode(F.array(*map(F.lit, speeds)))).withColumn("tick", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil((F.col("b") - F.col("a")) / step).cast("long"))))
    return each.select(key, "speed", "tick", F.least(F.col("b"), F.col("a") + step * F.col("tick")).alias("at"))
