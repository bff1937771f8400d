"""Streams: the same rows whatever the order of files and triggers, late rows told apart, logs written once."""

import pytest
from compare import duck_rows, spark_rows
from conftest import DATA
from pyspark.sql import functions as F

from kinetrace.functions.contracts import SEQUENCE
from kinetrace.operators import drive
from kinetrace.plans import live, oracle, queries
from kinetrace.streaming import ordered, streams
from kinetrace.streaming.sinks import BatchLog


def test_alerts_fire(spark, duck):
    names, want = duck_rows(duck, oracle.oracle_sql()["stream_alerts"])
    df = queries.queries()["stream_alerts"](spark, DATA)
    assert spark_rows(df) == want and df.where("alert_onset").count() > 0


def _scores(spark):
    return spark.range(2000).select(F.concat(F.lit("s"), F.col("id") % 3).alias(SEQUENCE), F.col("id").alias("window_end_idx"), F.pmod(F.xxhash64("id"), F.lit(100)).cast("double").alias("score"))


def _alerts(rows, threshold, k):
    """By sequence and window: active and onset, in plain Python."""
    out, run = {}, {}
    for r in sorted(rows, key=lambda r: r.window_end_idx):
        before = run.get(r[SEQUENCE], 0)
        run[r[SEQUENCE]] = before + 1 if r.score > threshold else 0
        out[r[SEQUENCE], r.window_end_idx] = (run[r[SEQUENCE]] >= k, run[r[SEQUENCE]] >= k > before)
    return out


@pytest.mark.parametrize("rows", [10, 10_000])
def test_order_and_arrow_batches_do_not_matter(spark, rows):
    source = _scores(spark).repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        ends = live._ends(source, SEQUENCE, "window_end_idx", 601)
        got = live.replay(source, lambda s: streams.threshold_alerts(s, SEQUENCE, 40.0, 3, 600), "window_end_idx", 600, ends)
        assert got.where("is_late").count() == 0
        got = {(r[SEQUENCE], r.window_end_idx): (r.alert_active, r.alert_onset) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = _alerts(_scores(spark).collect(), 40.0, 3)
    assert got == want and sum(a for a, _ in got.values()) > 100


def test_late_rows_are_told_apart(spark):
    """Rows come up to 600 late and 100 are allowed for: the others are folded as if the late ones were not there."""
    source = _scores(spark)
    out = live.replay(source, lambda s: streams.threshold_alerts(s, SEQUENCE, 40.0, 3, 100), "window_end_idx", 600, live._ends(source, SEQUENCE, "window_end_idx", 101))
    counts = {r[SEQUENCE]: (r.late_rows, r.all_rows) for r in ordered.late_counts(out, SEQUENCE).collect()}
    assert sum(n for _, n in counts.values()) == 2000 and all(0 < late < n for late, n in counts.values())
    late = out.where("is_late")
    assert late.where("alert_active is not null").count() == 0
    got = {(r[SEQUENCE], r.window_end_idx): (r.alert_active, r.alert_onset) for r in out.where("not is_late").collect()}
    names = {(r[SEQUENCE], r.window_end_idx) for r in late.collect()}
    assert got == _alerts([r for r in source.collect() if (r[SEQUENCE], r.window_end_idx) not in names], 40.0, 3)


def test_silent_keys_are_closed(spark):
    """A key that stops is folded to its end and leaves the state; no record stands for it."""
    source = _scores(spark).where(f"{SEQUENCE} <> 's0' or window_end_idx < 300")
    out = live.replay(source, lambda s: ordered.in_order(s, lambda: streams.ThresholdAlerts(40.0, 3), SEQUENCE, "window_end_idx", 50, idle=200), "window_end_idx")
    assert out.where(f"{SEQUENCE} = 's0'").count() == 100
    assert 0 < out.where(f"{SEQUENCE} = 's1'").count() < 667  # its last rows wait


def _records(spark):
    return live.command_records(spark, DATA).where("run <> 'P'")


def test_command_state_drops_and_counts_what_is_late(spark, tmp_path):
    """A record behind the watermark changes nothing, and Spark counts it."""
    records, folder = _records(spark), f"file://{tmp_path}"
    first, last = records.agg(F.min("at_ms"), F.max("at_ms")).first()
    middle = (first + last) // 2
    stray = records.where(f"at_ms = {first}").limit(1).select("run", F.lit(first + 7).cast("long").alias("at_ms"), F.lit("command").alias("kind"), *(F.lit(9.0).alias(c) for c in ("speed", "steer", "acceleration", "vx")), F.timestamp_millis(F.lit(first + 7)).alias("at"))
    clock = records.agg((F.max("at_ms") + 3_600_000).alias("at_ms")).select(F.lit("#clock").alias("run"), "at_ms", F.lit("odometry").alias("kind"), *(F.lit(0.0).alias(c) for c in ("speed", "steer", "acceleration", "vx")), F.timestamp_millis("at_ms").alias("at"))
    for part in (records.where(f"at_ms <= {middle}"), records.where(f"at_ms > {middle}").limit(1), stray.unionByName(records.where(f"at_ms > {middle}").exceptAll(records.where(f"at_ms > {middle}").limit(1))), clock):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    out = streams.command_state(spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), "run", "at", "100 milliseconds")
    query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    dropped = sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
    assert dropped >= 1
    got = spark.read.parquet(f"{folder}/out")
    want = drive.control_ticks(records, "run")
    assert got.count() == got.select("run", "tick_ms").distinct().count()
    late = {r.at_ms for r in records.where(f"at_ms > {middle}").collect()}
    safe = min(late) - 2000
    assert _told(got.where(f"tick_ms < {safe}")) == _told(want.where(f"tick_ms < {safe}"))


def test_ticks_come_while_records_do(spark):
    """A robot does not gather its records until the stream ends: each micro-batch makes the ticks up to the watermark."""
    records, sizes = _records(spark), []

    class Log(BatchLog):
        def __call__(self, df, batch):
            super().__call__(df, batch)
            sizes.append(df.sparkSession.read.parquet(f"{self.path}/rows/batch={batch}").count())

    clock = live._ends(records.select(F.lit("#clock").alias("run"), "at_ms", F.lit("odometry").alias("kind")), "run", "at_ms", 3_600_000).withColumns({"at": F.timestamp_millis("at_ms"), "kind": F.lit("odometry")})
    out = live.replay(records, lambda s: streams.command_state(s, "run", "at", "4 seconds"), "at", 4.0, clock, Log)
    assert _told(out) == _told(drive.control_ticks(records, "run"))
    assert sum(n > 0 for n in sizes) >= 4 and max(sizes) < 0.5 * sum(sizes)


def test_of_records_at_one_time_the_largest_counts(spark):
    """Whatever order they come in, and where values are missing, as in the batch form."""
    fields = [F.when(F.col("id") % k != 0, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(19)) / 10 - 0.9).alias(n) for k, n in ((5, "speed"), (7, "steer"), (9, "acceleration"), (4, "vx"))]
    records = spark.range(600).select(F.lit("r").alias("run"), (F.floor(F.col("id") / 3) * 170 + ordered.DAY_MS).alias("at_ms"), F.when(F.pmod(F.xxhash64("id"), F.lit(3)) > 0, "command").otherwise("odometry").alias("kind"), *fields)
    records = records.withColumn("at", F.timestamp_millis("at_ms")).localCheckpoint()
    clock = records.agg((F.max("at_ms") + 3_600_000).alias("at_ms")).withColumns({"at": F.timestamp_millis("at_ms"), "run": F.lit("#clock"), "kind": F.lit("odometry")})
    want = _told(drive.control_ticks(records, "run"))
    for mixed in (records, records.orderBy(F.xxhash64("at_ms", "speed", "vx"))):
        out = live.replay(mixed, lambda s: streams.command_state(s, "run", "at", "4 seconds"), "at", 4.0, clock, BatchLog)
        assert _told(out.where("run = 'r'")) == want and len(want) > 500


def _told(df):
    return sorted((r.run, r.tick_ms, round(r.raw_speed, 9), round(r.raw_steer, 9), round(r.raw_acceleration, 9)) for r in df.collect())


def test_feedback_may_be_off(spark):
    records = _records(spark)
    off = drive.control_ticks(records, "run", feedback="off")
    assert off.where("feedback_raw_speed <> 0").count() == 0 < off.where("raw_speed <> 0").count()
    shim, reading = drive.CommandShim(feedback="off"), (0.05, 0.1, 0.4, 0.2, 0.1, 0.3)
    assert shim.log(*reading)[6] == 0.0 == shim.integral and shim.log(*reading)[7] == pytest.approx(-0.4 / drive.VISUAL_MPS_PER_RAW)


class _Fails(BatchLog):
    """Stops once between a batch's rows and its record, and once after the record."""

    left = [1, 3]

    def before_record(self, batch):
        if batch == 1 and 1 in self.left:
            self.left.remove(1)
            raise RuntimeError("killed between write and record")

    def __call__(self, df, batch):
        super().__call__(df, batch)
        if batch == 3 and 3 in self.left:
            self.left.remove(3)
            raise RuntimeError("killed after the record")


def test_log_has_every_row_once(spark, tmp_path):
    folder, source = f"file://{tmp_path}", _scores(spark)
    for k in range(5):
        source.where(f"window_end_idx % 5 = {k}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    sink, stopped = _Fails(f"{folder}/log"), 0
    while True:
        stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        try:
            stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
            break
        except Exception:
            stopped += 1
            if stopped == 1:  # rows without a record are not read
                assert sink.read(spark, source.schema).count() == 400
    assert stopped == 2 and not sink.left
    assert sorted(map(tuple, sink.read(spark, source.schema).collect())) == sorted(map(tuple, source.collect()))
    sink.write_csv(spark, source.schema, f"{folder}/csv", "window_end_idx")
    assert spark.read.option("header", True).csv(f"{folder}/csv").count() == 2000


def test_phases_begin_when_the_gate_has_held(spark):
    rows = spark.createDataFrame([("a", float(t), t not in (3, 9)) for t in range(30)] + [("b", float(t), t % 2 == 0) for t in range(30)], "run string, t double, ok boolean")
    plan = [("one", 4.0, {"v": 1.0}), ("two", 6.0, {"v": 2.0})]
    got = drive.phase_schedule(rows, "run", "t", F.col("ok"), 5.0, plan).orderBy("run", "t").collect()
    a, b = ([(r.phase_name, r.cmd_v, r.phase_start) for r in got if r.run == run] for run in "ab")
    # Ready from 4 on without a break for five seconds, and again from 10: the gate opens at 15.
    assert a[:15] == [("startup", 1.0, None)] * 15 and a[15:19] == [("one", 1.0, 15.0)] * 4 and a[19:25] == [("two", 2.0, 19.0)] * 6 and a[25:] == [("done", 2.0, 25.0)] * 5
    assert set(b) == {("startup", 1.0, None)}


def test_nearest_takes_the_first_of_equals(spark):
    rows = spark.createDataFrame([("s", 1.0, 1), ("s", 3.0, 3), ("s", 3.0, 2), ("s", 9.0, 4)], "k string, t double, i int")
    asked = spark.createDataFrame([("s", x) for x in (0.0, 1.0, 2.0, 2.1, 3.0, 6.0, 6.1, 99.0)] + [("none", 1.0)], "k string, at double")
    got = {(r.k, r["at"]): (r.t, r.i) for r in drive.nearest(asked, rows, "k", "t", ["i"]).collect()}
    assert got == {("s", 0.0): (1.0, 1), ("s", 1.0): (1.0, 1), ("s", 2.0): (1.0, 1), ("s", 2.1): (3.0, 2), ("s", 3.0): (3.0, 2), ("s", 6.0): (3.0, 2), ("s", 6.1): (9.0, 4), ("s", 99.0): (9.0, 4), ("none", 1.0): (None, None)}


def test_micro_batches_are_bounded(spark, monkeypatch):
    """A larger table makes more micro-batches, not larger ones, and the same rows."""
    from kinetrace.plans import live

    monkeypatch.setattr(live, "TRIGGER_ROWS", 30)
    sizes = []

    class Log(live.BatchLog):
        def __call__(self, df, batch):
            sizes.append(df.count())
            super().__call__(df, batch)

    rows = spark.range(300).selectExpr("id", "cast(id as double) as t")
    out = live.replay(rows, lambda s: s, "t", late=5.0, log=Log)
    assert sorted(r["id"] for r in out.collect()) == list(range(300))
    assert len(sizes) == 10 and max(sizes) <= 60
