"""Queries of streams, and the batch queries that they must equal.

A table is replayed as a stream: its rows arrive in several micro-batches, late by
up to a bound and out of order, and a last record stands for the time that goes on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.contracts import QUATERNION, SEQUENCE, STEP, TIME
from ..operators import drive, score
from ..sources.scratch import materialize, shared_folder
from ..streaming import streams
from ..streaming.ordered import DAY_MS
from ..streaming.sinks import BatchLog
from . import base

#: Micro-batches of a query's stream at least, and rows of one on average: a key's worker holds those of its key.
TRIGGERS, TRIGGER_ROWS = 4, 1_000_000
#: A score that about a fifth of the windows of the test tables exceed.
STREAM_THRESHOLD = 0.163
#: By how much records are late at most: rows of the score timeline, seconds of drive rows, milliseconds of commands.
LATE_ROWS, LATE_S, LATE_MS = 400, 500.0, 4000
#: Phases of a drive test: name, seconds, and the command given. Fixed values.
DRIVE_PLAN = [
    ("pre_stop", 2.0, {"speed": 0.0, "steer": 0.0, "lift": 0.0}),
    ("lift_raise", 2.0, {"speed": 0.0, "steer": 0.0, "lift": 0.8}),
    ("straight_forward", 4.0, {"speed": 0.25, "steer": 0.0, "lift": 0.8}),
    ("left_arc", 6.0, {"speed": 0.2, "steer": 0.45, "lift": 0.8}),
    ("stop_high", 1.5, {"speed": 0.0, "steer": 0.0, "lift": 0.8}),
    ("lift_lower", 2.0, {"speed": 0.0, "steer": 0.0, "lift": 0.0}),
    ("final_stop", 2.0, {"speed": 0.0, "steer": 0.0, "lift": 0.0}),
]
#: Drive rows come every few seconds and not many times a second; the plan is stretched by so much.
STRETCH, READY_S = 100.0, 30.0
PLAYHEAD_S, PLAYHEAD_SPEEDS = 600.0, [1, 4, 10]


def replay(source: DataFrame, build, time: str, late: float = 0.0, clock: DataFrame | None = None, log: type[BatchLog] | None = None) -> DataFrame:
    """What ``build`` makes of ``source``, streamed in TRIGGERS micro-batches, or more of about TRIGGER_ROWS each.

    A row arrives up to ``late`` after its ``time``, by its hash.  ``clock`` has records that
    arrive after all others.  Rows come out in append mode, into files or a log.
    """
    spark, folder = source.sparkSession, f"{shared_folder(source.sparkSession)}/stream-{uuid.uuid4().hex}"
    source.write.parquet(f"{folder}/all")
    stored = spark.read.schema(source.schema).parquet(f"{folder}/all")
    at = F.col(time).cast("double")
    arrives = at + F.pmod(F.xxhash64(*source.columns), F.lit(1000)) / 1000 * late
    first, last, rows = stored.agg(F.min(at), F.max(at), F.count(F.lit(1))).first()
    span = (last or 0.0) - (first or 0.0) + late
    triggers = max(TRIGGERS, -(-rows // TRIGGER_ROWS))
    part = F.least(F.lit(triggers - 1), F.floor((arrives - F.lit(first or 0.0)) * triggers / F.lit(span * 1.0001 + 1e-9))).cast("int")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Dealt once into a folder each, so that a micro-batch reads its own rows and not the whole table again; by several tasks each, as there may be fewer micro-batches than cores.
    stored.withColumn("__trigger", part).repartition("__trigger", F.pmod(F.xxhash64(*source.columns), F.lit(files))).write.partitionBy("__trigger").parquet(f"{folder}/dealt")
    dealt = spark.read.schema(f"{', '.join(f'`{n}` {t}' for n, t in source.dtypes)}, __trigger int").parquet(f"{folder}/dealt")
    for k in range(triggers):
        dealt.where(F.col("__trigger") == k).drop("__trigger").repartition(files).write.mode("append").parquet(f"{folder}/in")
    if clock is not None:
        clock.select(*(F.col(n).cast(t) if n in clock.columns else F.lit(None).cast(t).alias(n) for n, t in source.dtypes)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    out = build(spark.readStream.schema(source.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in"))
    writer = out.writeStream.option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True)
    if log is None:
        writer.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{folder}/out")
    sink = log(f"{folder}/log")
    writer.foreachBatch(sink).start().awaitTermination()
    return sink.read(spark, out.schema)


def _ends(source: DataFrame, key: str, time: str, after: float) -> DataFrame:
    """A record of each key, so much after its last one."""
    return source.groupBy(key).agg((F.max(time) + after).alias(time))


def _timed_events(spark, d):
    return base.event_times(spark, d).select("event_type", "user_id", "value", F.timestamp_micros(F.expr(f"{TIME} div 1000")).alias("at"))


def _windows(spark, d, build):
    """Windows that have closed when the clock stands a thousand days after the last event."""
    events = _timed_events(spark, d)
    clock = events.agg((F.max("at") + F.expr("interval 1000 days")).alias("at")).withColumn("event_type", F.lit("#clock"))
    return replay(events, build, "at", late=86400.0, clock=clock).withColumn("window_start_us", F.unix_micros("w.start")).drop("w")


def stream_tumbling(spark, d):
    return _windows(spark, d, lambda s: streams.tumbling_counts(s, "at", "1 day", "2 days"))


def stream_sliding(spark, d):
    return _windows(spark, d, lambda s: streams.sliding_counts(s, "at", "2 days", "1 day", "2 days"))


def stream_sessions(spark, d):
    return _windows(spark, d, lambda s: streams.sessions(s, "at", "6 hours", "2 days", "user_id"))


def stream_odom(spark, d):
    tel = base.telemetry(spark, d).withColumns({"vx": F.col("lin_acc_x"), "vy": F.col("lin_acc_y"), "vz": F.col("lin_acc_z")})
    return replay(tel, streams.odometry, TIME).select(SEQUENCE, TIME, STEP, *QUATERNION, "vx", "vy", "vz")


def _timeline(spark, d):
    return score.trailing_mean_scores(base.telemetry(spark, d))


def stream_alerts(spark, d):
    """Persistence over a fixed threshold, a stream of the score timeline."""
    scores = _timeline(spark, d).select(SEQUENCE, "window_end_idx", "score")
    out = replay(scores, lambda s: streams.threshold_alerts(s, SEQUENCE, STREAM_THRESHOLD, 2, LATE_ROWS), "window_end_idx", LATE_ROWS, _ends(scores, SEQUENCE, "window_end_idx", LATE_ROWS + 1))
    return out.where("not is_late").drop("is_late")


def stream_adaptive(spark, d):
    prepared = score.adaptive_baseline(materialize(_timeline(spark, d), "timeline")).select(SEQUENCE, "window_end_idx", "score", "trailing_median", "trailing_mad")
    out = replay(prepared, lambda s: streams.adaptive_alerts(s, SEQUENCE, LATE_ROWS, z=2.0), "window_end_idx", LATE_ROWS, _ends(prepared, SEQUENCE, "window_end_idx", LATE_ROWS + 1))
    return out.where("not is_late").select(SEQUENCE, "window_end_idx", "alert_active", "alert_onset")


def _ticks(spark, d):
    return base.drive_rows(spark, d).select("run", "t", (F.pmod(F.col("t"), F.lit(10.0)) / 15).alias("age"), F.col("cmd_speed").alias("speed"), F.col("yaw").alias("steer"), F.col("x").alias("acceleration"), "vx")


def pi_shim(spark, d):
    return drive.run_shim(_ticks(spark, d), "run")


def stream_pi_shim(spark, d):
    ticks = _ticks(spark, d)
    out = replay(ticks, lambda s: streams.command_shim(s, "run", LATE_S), "t", LATE_S, _ends(ticks, "run", "t", LATE_S + 1))
    return out.where("not is_late").select("run", "t", "raw_speed", "raw_steer", "raw_acceleration")


def command_records(spark, d):
    """Orders as records of robots, 20 ms apart: every fourth is a command, and some of these are stops."""
    o = base.table(spark, d, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    command = key % 4 == 0
    given = lambda c: F.when(command, c)
    return o.select(
        F.col("o_orderstatus").alias("run"),
        (key * 20 + DAY_MS).alias("at_ms"),
        F.when(command, "command").otherwise("odometry").alias("kind"),
        given(F.when(key % 32 == 0, 0.0).otherwise((cust % 5 + 1) / 10.0)).alias("speed"),
        given((key % 63) / 10.0 - 3.1).alias("steer"),
        given((cust % 100) / 10.0 - 5.0).alias("acceleration"),
        F.when(~command, (key % 7 - 3) / 10.0).alias("vx"),
        F.timestamp_millis(key * 20 + DAY_MS).alias("at"),
    )


def command_log(spark, d):
    return drive.control_ticks(command_records(spark, d), "run")


def stream_command_state(spark, d):
    """The live control log, through a log sink that takes each micro-batch once."""
    records = command_records(spark, d)
    clock = records.agg((F.max("at") + F.expr("interval 1 hour")).alias("at"), (F.max("at_ms") + 3_600_000).alias("at_ms")).withColumns({"run": F.lit("#clock"), "kind": F.lit("odometry")})
    return replay(records, lambda s: streams.command_state(s, "run", "at", f"{LATE_MS} milliseconds"), "at", LATE_MS / 1000, clock, BatchLog)


def phase_schedule(spark, d):
    """A drive test's phases, from the moment at which the readiness gate has held."""
    rows = base.drive_rows(spark, d).select("run", "t", "x", "y")
    plan = [(name, seconds * STRETCH, command) for name, seconds, command in DRIVE_PLAN]
    return drive.phase_schedule(rows, "run", "t", F.col("t") % 9 != 0, READY_S, plan)


def playhead_rows(spark, d):
    """The row of the score timeline that a playhead shows, at three speeds."""
    timeline = materialize(_timeline(spark, d).select(SEQUENCE, "time_s", "window_end_idx", "score", "top_group"), "timeline")
    heads = drive.playheads(timeline, SEQUENCE, "time_s", PLAYHEAD_S, PLAYHEAD_SPEEDS)
    return drive.nearest(heads, timeline, SEQUENCE, "time_s", ["window_end_idx", "score", "top_group"])


QUERIES = [stream_tumbling, stream_sliding, stream_sessions, stream_odom, stream_alerts, stream_adaptive, pi_shim, stream_pi_shim, command_log, stream_command_state, phase_schedule, playhead_rows]
