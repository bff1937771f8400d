"""Keyed state over records that come late and out of order.

A key's records wait in a buffer until nothing earlier is to be expected, are
then taken in time and folded by one state machine.  What comes after its
time is not folded but told apart and counted.  Buffers hold what a key sends during
the allowed delay; a key that has been silent for ``idle`` of event time, by the
stream's watermark, is closed: its buffer is folded and its state goes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
DAY_MS = 24 * 3600 * 1000
#: Added to times, as Spark's watermark begins at 0 and drops what is not later.
ORIGIN_S = 10 * 24 * 3600


class Fold:
    """What is done with a key's rows in time: ``start`` from a state's values or none, ``take`` rows, give ``state`` back."""

    #: Columns that ``take`` adds, and those of the state, as DDL.
    added: str
    kept: str

    def start(self, state: tuple | None) -> None:
        raise NotImplementedError

    def take(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The rows, which are in time, with the added columns."""
        raise NotImplementedError

    def state(self) -> tuple:
        raise NotImplementedError


class _InOrder(StatefulProcessor):
    def __init__(self, make: Callable[[], Fold], key: str, time: str, columns: list[str], schema: str, delay: float, idle: float):
        self.make, self.key, self.time, self.columns, self.schema, self.delay, self.idle = make, key, time, columns, schema, delay, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.folded = handle.getValueState("folded", self.make().kept)
        # The key's own watermark: all up to ``passed`` has been folded, ``latest`` is the newest time seen.
        self.times = handle.getValueState("times", "latest double, passed double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        latest, passed = self.times.get() or (float("-inf"), float("-inf"))
        latest = max(latest, float(new[self.time].max()))
        late = new[self.time].astype(float) <= passed
        if late.any():
            yield self._told(new[late], True)
        waiting, new = self._buffer(), new.loc[~late, self.columns]
        waiting = pd.concat([waiting, new]) if len(waiting) and len(new) else new if len(new) else waiting
        ready = waiting[self.time].astype(float) <= latest - self.delay
        if ready.any():
            yield self._fold(waiting[ready])
            passed = latest - self.delay
        self.times.update((latest, passed))
        rest = waiting[~ready]
        self.waiting.clear()
        if len(rest):
            self.waiting.put([tuple(_plain(v) for v in r) for r in rest.itertuples(index=False)])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((latest + self.idle + ORIGIN_S) * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = self._buffer()
        if len(waiting):
            yield self._fold(waiting)
        for state in (self.waiting, self.folded, self.times):
            state.clear()

    def _buffer(self) -> pd.DataFrame:
        return pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=self.columns)

    def _fold(self, rows: pd.DataFrame) -> pd.DataFrame:
        fold = self.make()
        fold.start(self.folded.get() if self.folded.exists() else None)
        out = fold.take(rows.sort_values(self.time, kind="stable").reset_index(drop=True))
        self.folded.update(fold.state())
        return self._told(out, False)

    def _told(self, rows: pd.DataFrame, late: bool) -> pd.DataFrame:
        added = [part.split()[0] for part in self.make().added.split(", ")]
        rows = rows.assign(is_late=late, **{n: None for n in added if n not in rows.columns})
        return rows[[*self.columns, *added, "is_late"]]

    def close(self) -> None:
        pass


def _plain(value):
    return value.item() if hasattr(value, "item") else value


def in_order(stream: DataFrame, make: Callable[[], Fold], key: str, time: str, delay: float, idle: float | None = None) -> DataFrame:
    """Rows of ``stream`` with what ``make()`` adds to them in time, and ``is_late``.

    ``time`` is a number; ``delay`` and ``idle`` (a hundred times the delay if not given) are in its
    units.  A row that comes when later rows of its key have already been folded has is_late set and no added
    values; a row that is later than ``idle`` behind the whole stream is dropped and counted by Spark.
    """
    stream.sparkSession.conf.set(*STATE_STORE)
    idle = 100 * delay if idle is None else idle
    schema = ", ".join(f"`{n}` {t}" for n, t in stream.dtypes)
    processor = _InOrder(make, key, time, stream.columns, schema, delay, idle)
    at = F.timestamp_micros(((F.col(time) + ORIGIN_S) * 1_000_000).cast("long"))
    timed = stream.withColumn("_at", at).withWatermark("_at", f"{int(idle * 1000)} milliseconds")
    return timed.groupBy(key).transformWithStateInPandas(processor, f"{schema}, {make().added}, is_late boolean", "append", "EventTime")


def late_counts(rows: DataFrame, key: str) -> DataFrame:
    """How many rows of each key came too late."""
    return rows.groupBy(key).agg(F.count_if("is_late").alias("late_rows"), F.count(F.lit(1)).alias("all_rows"))
