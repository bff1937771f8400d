"""Live forms of the operators, on Structured Streaming.

Stateful ones fold a key's rows in time, whatever the order in which files and
triggers bring them: see ``ordered``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.adaptive import AlertState
from ..operators.drive import HOLD_MS, TICK_LOG, TICK_MS, CommandShim, normalize_odometry
from .ordered import DAY_MS, STATE_STORE, Fold, in_order

#: A robot's record as it waits in the state, many in one value, and how many are worked through at a time: each makes HOLD_MS / TICK_MS + 1 ticks at most.
RECORD = np.dtype([("at_ms", "i8"), ("command", "?"), ("speed", "f8"), ("steer", "f8"), ("acceleration", "f8"), ("vx", "f8")])
RECORDS = 10_000


def odometry(stream: DataFrame) -> DataFrame:
    """Stateless; the batch operator does."""
    return normalize_odometry(stream)


def tumbling_counts(stream: DataFrame, time: str, length: str, late: str) -> DataFrame:
    """Rows and sum per event-time window and type; a window comes out, and leaves the state, when it has closed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sliding_counts(stream: DataFrame, time: str, length: str, slide: str, late: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, length, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    """Bursts of a key's events, parted by ``gap``."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))


class ThresholdAlerts(Fold):
    """Persistence over a fixed threshold; the state is the run of positives."""

    added, kept = "alert_active boolean, alert_onset boolean", "length int"

    def __init__(self, threshold: float, k: int):
        self.threshold, self.k = threshold, k

    def start(self, state: tuple | None) -> None:
        (self.length,) = state or (0,)

    def take(self, rows: pd.DataFrame) -> pd.DataFrame:
        active, onset = [], []
        for positive in rows["score"] > self.threshold:
            was, self.length = self.length >= self.k, self.length + 1 if positive else 0
            active.append(self.length >= self.k)
            onset.append(self.length >= self.k and not was)
        return rows.assign(alert_active=active, alert_onset=onset)

    def state(self) -> tuple:
        return (self.length,)


class AdaptiveAlerts(Fold):
    """The batch operator's state machine, over rows that bring their trailing median and distance."""

    added, kept = "alert_active boolean, alert_onset boolean", "active boolean, baseline double, scale double, run int"

    def __init__(self, k: int, **settings):
        self.k, self.settings = k, settings

    def start(self, state: tuple | None) -> None:
        self.fold = AlertState(self.k, **self.settings)
        if state:
            self.fold.active, self.fold.baseline, self.fold.scale, self.fold.run = state

    def take(self, rows: pd.DataFrame) -> pd.DataFrame:
        steps = [self.fold.step(*r) for r in zip(rows["score"], rows["trailing_median"], rows["trailing_mad"], strict=True)]
        return rows.assign(alert_active=[s[4] for s in steps], alert_onset=[s[5] for s in steps])

    def state(self) -> tuple:
        return bool(self.fold.active), float(self.fold.baseline), float(self.fold.scale), int(self.fold.run)


class ShimTicks(Fold):
    """PI control of a robot's ticks (t, age, speed, steer, acceleration, vx)."""

    added, kept = "raw_speed double, raw_steer double, raw_acceleration double", "integral double, last double"

    def __init__(self, **settings):
        self.settings = settings

    def start(self, state: tuple | None) -> None:
        self.shim = CommandShim(**self.settings)
        self.shim.integral, self.last = state or (0.0, None)

    def take(self, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.itertuples():
            dt = max(r.t - self.last, 1e-6) if self.last is not None else 1e-6
            self.last = r.t
            out.append(self.shim.tick(dt, r.age, r.speed, r.steer, r.acceleration, -r.vx)[:3])
        return rows.assign(**dict(zip(["raw_speed", "raw_steer", "raw_acceleration"], zip(*out, strict=True), strict=True)))

    def state(self) -> tuple:
        return float(self.shim.integral), None if self.last is None else float(self.last)


def threshold_alerts(scores: DataFrame, key: str, threshold: float, k: int, delay: float) -> DataFrame:
    """Windows (key, window_end_idx, score) with persistence over ``threshold``."""
    return in_order(scores, lambda: ThresholdAlerts(threshold, k), key, "window_end_idx", delay)


def adaptive_alerts(scores: DataFrame, key: str, delay: float, k: int = 2, **settings) -> DataFrame:
    """As the batch operator, from rows that bring their trailing median and distance."""
    return in_order(scores, lambda: AdaptiveAlerts(k, **settings), key, "window_end_idx", delay)


def command_shim(ticks: DataFrame, key: str, delay: float, **settings) -> DataFrame:
    """PI control of each robot's ticks."""
    return in_order(ticks, lambda: ShimTicks(**settings), key, "t", delay)


class _CommandState(StatefulProcessor):
    """The newest command and speed of a robot, and a control step every TICK_MS of its own time.

    Records (at_ms, kind, speed, steer, acceleration, vx) wait until the watermark has
    passed them.  A timer at the next tick wakes the robot when the watermark has reached it, whether
    or not more records come then; all ticks up to the watermark are made, each with what was newest at its time.
    So records of few micro-batches wait, and they are sorted and worked out as arrays.
    Ticks pause while nothing has been heard for HOLD_MS.  Of several records of a kind at one time the largest counts.
    """

    def __init__(self, key: str, record: str, ttl_ms: int, settings: dict):
        self.key, self.record, self.ttl_ms, self.settings = key, record, ttl_ms, settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "records binary")
        self.newest = handle.getValueState("newest", "records binary")
        self.control = handle.getValueState("control", "tick long, last long, integral double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = np.concatenate([*map(_packed, rows)])
        self.waiting.appendList(_stored(new))
        # A timer that is due stays: it goes off in this micro-batch, after the rows.
        due = int(new["at_ms"].min()) + HOLD_MS + TICK_MS
        if due < min(self.handle.listTimers(), default=due + 1):
            self._wake_at(due, timerValues)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All records up to the watermark are there; later ones may lack neighbours.
        upto = timerValues.getCurrentWatermarkInMs()
        waiting = _in_time([np.frombuffer(r[0], RECORD) for r in self.waiting.get()] if self.waiting.exists() else [np.empty(0, RECORD)])
        ready, rest = np.split(waiting, [np.searchsorted(waiting["at_ms"], upto, side="right")])
        newest = np.frombuffer(self.newest.get()[0] if self.newest.exists() else b"", RECORD)
        tick, last, integral = self.control.get() if self.control.exists() else (None, None, 0.0)
        shim = CommandShim(**self.settings)
        shim.integral = integral
        for start in range(0, max(len(ready), 1), RECORDS):
            records, behind = np.concatenate([newest, ready[start : start + RECORDS]]), ready[start + RECORDS : start + RECORDS + 1]
            if not len(records):
                break
            tick = int(records["at_ms"][0]) if tick is None else tick
            ticks, row = _grid(records, tick, int(behind["at_ms"][0]) - 1 if len(behind) else upto)
            rows = np.arange(len(records))
            command, odometry = (np.maximum.accumulate(np.where(chosen, rows, -1)) for chosen in (records["command"], ~records["command"]))
            if len(ticks):
                yield self._logged(key[0], shim, records, ticks, command[row], odometry[row], last)
                tick, last = int(ticks[-1]) + TICK_MS, int(ticks[-1])
            newest = records[sorted(k for k in (command[-1], odometry[-1]) if k >= 0)]
        heard = int(newest["at_ms"][-1]) if len(newest) else None
        if heard is not None:
            self.newest.update((newest.tobytes(),))
            self.control.update((tick, last, float(shim.integral)))
        self.waiting.clear()
        if len(rest):
            self.waiting.put(_stored(rest))
            self._wake_at(int(rest["at_ms"][0]) + HOLD_MS + TICK_MS, timerValues)
        elif heard is not None and upto < heard + self.ttl_ms:
            self._wake_at(heard + (HOLD_MS + TICK_MS if upto < heard + HOLD_MS else self.ttl_ms), timerValues)
        else:  # the robot has been silent for long: nothing of it stays
            for state in (self.newest, self.control):
                state.clear()

    def _logged(self, name, shim: CommandShim, records: np.ndarray, ticks: np.ndarray, command: np.ndarray, odometry: np.ndarray, last: int | None) -> pd.DataFrame:
        """Ticks with what they do; ``command`` and ``odometry``: the newest record of a kind at each, -1 if there is none."""
        told = lambda n, k: np.where((k < 0) | np.isnan(records[n][k]), 0.0, records[n][k])
        age = np.where(command < 0, np.nan, (ticks - records["at_ms"][command]) / 1000)
        dt = np.maximum(np.diff(ticks, prepend=ticks[0] if last is None else last) / 1000, 1e-6)
        out = shim.logs(dt, age, *(told(n, command) for n in ("speed", "steer", "acceleration")), -told("vx", odometry))
        return pd.DataFrame({self.key: name, "tick_ms": ticks, **dict(zip(TICK_LOG, out, strict=True)), "command_age_s": age})

    def _wake_at(self, ms: int, timerValues) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(int(ms), timerValues.getCurrentWatermarkInMs() + 1))

    def close(self) -> None:
        pass


def _packed(new: pd.DataFrame) -> np.ndarray:
    """Records as RECORD; what a kind has no use for is NaN, as what is not given."""
    records = np.empty(len(new), RECORD)
    records["at_ms"], records["command"] = new["at_ms"].astype("int64"), new["kind"] == "command"
    for n in ("speed", "steer", "acceleration", "vx"):
        records[n] = np.where(records["command"] == (n != "vx"), new[n].astype(float), np.nan)
    return records


def _stored(records: np.ndarray) -> list[tuple[bytes]]:
    return [(records[k : k + 10 * RECORDS].tobytes(),) for k in range(0, len(records), 10 * RECORDS)]


def _in_time(parts: list[np.ndarray]) -> np.ndarray:
    """Records by time; of those at one time the largest comes last."""
    records = np.concatenate(parts)
    values = [np.where(np.isnan(records[n]), -np.inf, records[n]) for n in ("vx", "acceleration", "steer", "speed")]
    return records[np.lexsort([*values, records["at_ms"]])]


def _grid(records: np.ndarray, tick: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ticks from ``tick`` to ``end``, each with the record that it follows; none more than HOLD_MS behind its record."""
    at = records["at_ms"]
    first = np.maximum(-((tick - at) // TICK_MS), 0)
    last = (np.minimum(np.append(at[1:] - 1, end), at + HOLD_MS) - tick) // TICK_MS
    count = np.maximum(last - first + 1, 0)
    row = np.repeat(np.arange(len(at)), count)
    nth = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    return tick + (first[row] + nth) * TICK_MS, row


def command_state(records: DataFrame, key: str, time: str, late: str, ttl_ms: int = DAY_MS, **settings) -> DataFrame:
    """Control log of each robot from its commands and odometry, 20 ticks a second of event time.

    ``records``: key, ``time`` (timestamp), at_ms, kind (command or odometry), speed, steer,
    acceleration, vx.  Records behind the watermark are dropped and counted by Spark as
    ``numRowsDroppedByWatermark``.
    """
    records.sparkSession.conf.set(*STATE_STORE)
    kind = records.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, tick_ms long, {', '.join(f'{n} double' for n in TICK_LOG)}, command_age_s double"
    processor = _CommandState(key, "", ttl_ms, settings)
    return records.withWatermark(time, late).groupBy(key).transformWithStateInPandas(processor, schema, "append", "EventTime")
