"""Windows in parts of a sequence give what windows over the whole sequence give."""

import pytest
from compare import spark_rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinetrace.functions.columns import rounded
from kinetrace.functions.contracts import RAW, SEQUENCE, STEP, TIME
from kinetrace.operators import adaptive, blocks, drive, evaluate, resample, score
from kinetrace.plans import base, queries

DATA = "/root/testdata/sf0.01"


def _small(monkeypatch):
    """Parts of few rows, so that sequences have many."""
    monkeypatch.setattr(blocks, "PART_ROWS", 330)
    monkeypatch.setattr(blocks, "TIME_ROWS", 900)
    monkeypatch.setattr(score, "BASELINE_ROWS", 70)


def _timeline(spark):
    return score.window_scores(score.trailing_mean_residuals(base.telemetry(spark, DATA)))


@pytest.fixture()
def telemetry(spark):
    return base.telemetry(spark, DATA).where(f"{STEP} < 1000")


def test_numbers_of_parts(spark):
    rows = [(s, None if i < 2 else i * i % 97, i) for s in ("a", "b", None) for i in range(80)]
    df = spark.createDataFrame(rows, "s string, t long, i long")
    want = df.withColumn("n", (F.row_number().over(Window.partitionBy("s").orderBy("t", "i")) - 1).cast("long"))
    old, blocks.TIME_ROWS = blocks.TIME_ROWS, 20
    try:
        assert spark_rows(blocks.numbered(df, ["s"], "t", ["t", "i"], "n")) == spark_rows(want)
    finally:
        blocks.TIME_ROWS = old


def test_scores_in_parts(spark, monkeypatch):
    whole = spark_rows(rounded(_timeline(spark)))
    _small(monkeypatch)
    parts = base.telemetry(spark, DATA).withColumn("p", F.floor(F.col(STEP) / blocks.PART_ROWS))
    assert parts.select(SEQUENCE, "p").distinct().count() > 10
    assert spark_rows(rounded(_timeline(spark))) == whole


def test_trailing_means_by_hand(spark, monkeypatch, telemetry):
    _small(monkeypatch)
    c = RAW[4]
    before = Window.partitionBy(SEQUENCE).orderBy(STEP).rowsBetween(-25, -1)
    want = telemetry.select(SEQUENCE, STEP, F.coalesce(F.pow(F.col(c) - F.avg(c).over(before), F.lit(2.0)), F.lit(0.0)).alias("r"))
    assert spark_rows(score.trailing_mean_residuals(telemetry, [c]).select(SEQUENCE, STEP, F.col(f"r_{c}").alias("r"))) == spark_rows(want)


def test_adaptive_alerts_in_parts(spark, monkeypatch):
    timeline = _timeline(spark).drop(TIME)
    whole = spark_rows(rounded(adaptive.adaptive_alerts(timeline, k=2, z=2.0)))
    _small(monkeypatch)
    assert spark_rows(rounded(adaptive.adaptive_alerts(timeline, k=2, z=2.0))) == whole
    assert any(True in r for r in whole)


def test_quiet_places_by_brute_force(spark, monkeypatch):
    _small(monkeypatch)
    timeline = _timeline(spark)
    annotated = score.annotate(timeline, score.percentile_threshold(timeline, 99.0), 2)
    lengths = base.lengths(base.event_times(spark, DATA))
    got = spark_rows(rounded(evaluate.quiet_segments(annotated, lengths, 40, 25)))
    windows: dict = {}
    for r in annotated.collect():
        windows.setdefault(r[SEQUENCE], []).append((r["window_start_idx"], r["window_end_idx"], r["score"], r["alert_active"]))
    median = lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2
    want = []
    for r in lengths.collect():
        for s in range(150, max(150, r["n"] - 40 - 150 - 1) + 1, 25):
            near = [w for w in windows.get(r[SEQUENCE], []) if w[1] >= s - 150 and w[0] <= s + 190]
            if near and not any(w[3] for w in near):
                past = [w[2] for w in near if w[1] < s]
                want.append((r[SEQUENCE], s, max(w[2] for w in near), median(past or [w[2] for w in near])))
    key = lambda r: (r[0], r[1])
    columns = sorted(["sequence_name", "start_index", "region_max_score", "baseline_score"])
    found = sorted(([dict(zip(columns, r, strict=True)) for r in got]), key=lambda r: (r["sequence_name"], r["start_index"]))
    assert [(r["sequence_name"], r["start_index"]) for r in found] == [key(r) for r in sorted(want)] and found
    for r, w in zip(found, sorted(want), strict=True):
        assert r["region_max_score"] == pytest.approx(w[2], abs=2e-6) and r["baseline_score"] == pytest.approx(w[3], abs=2e-6)


@pytest.mark.parametrize("clamp", [True, False])
def test_interpolation_in_parts(spark, monkeypatch, clamp):
    """Parts without source rows take their neighbours from far off."""
    source = spark.createDataFrame([(s, t, float(t * t)) for s in "ab" for t in (10, 11, 12, 500, 501, 900)], f"{SEQUENCE} string, {TIME} long, v double")
    grid = spark.createDataFrame([(s, t) for s in "abc" for t in range(0, 1000, 7)], f"{SEQUENCE} string, {TIME} long")
    want = spark_rows(resample.interpolate(grid, source, ["v"], clamp))
    monkeypatch.setattr(blocks, "TIME_ROWS", 15)
    assert spark_rows(resample.interpolate(grid, source, ["v"], clamp)) == want and len(want) == 429


def test_gates_in_parts(spark, monkeypatch):
    """A gate that opens, or is broken, in another part than it began."""
    bad = {"a": {3, 40, 41}, "b": set(range(0, 100, 9)), "c": {10}}
    rows = spark.createDataFrame([(k, float(t), t not in b) for k, b in bad.items() for t in range(100) if (k, t % 50 // 30) != ("c", 1)], "run string, t double, ok boolean")
    want = [("a", 34.0), ("c", 50.0)]
    assert spark_rows(drive.gate_opens(rows, "run", "t", F.col("ok"), 30.0).select(F.col("run").alias("a"), F.col("opened").alias("b"))) == want
    monkeypatch.setattr(blocks, "TIME_ROWS", 12)
    assert spark_rows(drive.gate_opens(rows, "run", "t", F.col("ok"), 30.0).select(F.col("run").alias("a"), F.col("opened").alias("b"))) == want


def test_windows_by_brute_force(spark, monkeypatch):
    """Nulls count for nothing, NaN is the largest, a window needs all its rows, and parts cut no window."""
    import random

    rng, columns = random.Random(3), [f"r_{c}" for c in RAW]
    cell = lambda s, i: None if i % 97 == 5 and s == "a" else float("nan") if (s, i) == ("b", 77) else rng.random()
    rows = [(s, 10**9 * (i + 1), i, *(cell(s, i) for _ in columns)) for s, first, n in (("a", 0, 700), ("b", 3, 400), ("c", 0, 149)) for i in range(first, first + n)]
    df = spark.createDataFrame(rows, f"{SEQUENCE} string, {TIME} long, {STEP} long, {', '.join(f'{c} double' for c in columns)}").repartition(5)
    want = []
    for s in "ab":
        own = {r[2]: r for r in rows if r[0] == s}
        for start in (i for i in own if i % 5 == 0 and i + 149 in own):
            means = [sum(own[i][3:]) / 10 for i in range(start, start + 150) if None not in own[i][3:]]
            top = sum(sorted(means, key=lambda x: (x != x, x))[-8:]) / 8
            want.append((s, start, (start + 149 - min(own)) * 1.0, None if top != top else round(top, 6)))
    for part in (20_000, 60):
        monkeypatch.setattr(blocks, "PART_ROWS", part)
        got = score.window_scores(df).select(SEQUENCE, "window_start_idx", "time_s", F.round("score", 6).alias("z"))
        assert spark_rows(got.toDF("a", "b", "c", "d")) == sorted(want, key=str)


def test_trailing_means_are_found_where_windows_are_cut(spark, monkeypatch, telemetry):
    """The same scores as by residuals of rows, with nulls and NaN, in parts of few rows; the plan sorts and frames rows for their numbers only."""
    holes = {c: F.when(F.col(STEP) % m == 3, None).when((F.col(STEP) == 20 * m) & (F.col("event_id") % 2 == 0), float("nan")).otherwise(F.col(c)) for c, m in zip(RAW[:4], (2, 7, 11, 13), strict=True)}
    df, plans = telemetry.withColumns(holes).withColumn(RAW[5], F.when(F.col(STEP) > 60, F.col(RAW[5]))), []
    want = spark_rows(score.window_scores(score.trailing_mean_residuals(df)))
    written = score.materialize
    monkeypatch.setattr(score, "materialize", lambda rows, name: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or written(rows, name))
    for part in (20_000, 60):
        monkeypatch.setattr(blocks, "PART_ROWS", part)
        assert spark_rows(score.trailing_mean_scores(df)) == want and len(want) > 500
    base_plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert all(plan.count("Window [") == base_plan.count("Window [") > 0 for plan in plans)
    queries.score_threshold(spark, DATA)
    assert len(plans) == 3 and "avg(" not in plans[2]


def test_timeline_reads_its_rows_once(spark):
    """Scores and the times that they are counted from come from one pass over the rows."""
    assert not any("events" in f for f in _timeline(spark).inputFiles())


def test_residuals_of_models_by_hand(spark):
    """What rows lose when they are projected by their own sequence's model; empty batches and nulls pass."""
    from kinetrace.operators import models

    made = spark.createDataFrame([("a", [1.0, 2.0], [2.0, 1.0], [0.5, 0.5, 0.5, 0.5]), ("b", [0.0, 0.0], [1.0, 1.0], [1.0, 0.0, 0.0, 0.0])], f"{SEQUENCE} string, mean array<double>, scale array<double>, projector array<double>")
    rows = spark.createDataFrame([("a", 1, 5.0, 2.0), ("b", 2, 3.0, 4.0), ("b", 3, None, 4.0), ("c", 4, 1.0, 1.0)], f"{SEQUENCE} string, {STEP} int, x double, y double").repartition(9)
    got = models.pca_residuals(rows, ["x", "y"], made)
    assert got.columns == [SEQUENCE, STEP, "x", "y", "r_x", "r_y"]
    assert spark_rows(got.select(F.col(STEP).alias("a"), F.col("r_x").alias("b"), F.col("r_y").alias("c"))) == [(1, 1.0, 1.0), (2, 0.0, 16.0), (3, None, None)]
    assert models.pca_residuals(rows.where("x > 100"), ["x", "y"], made).count() == 0


def test_control_ticks_in_parts(spark, monkeypatch):
    """Commands, pauses and stops that reach over parts of few records; no window takes a robot's whole log."""
    from kinetrace.plans import live

    records = live.command_records(spark, DATA).where("at_ms % 7 <> 3")
    whole = spark_rows(rounded(drive.control_ticks(records, "run")))
    monkeypatch.setattr(blocks, "TIME_ROWS", 500)
    parts = drive.control_ticks(records, "run")
    assert spark_rows(rounded(parts)) == whole and len(whole) > 1000
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    ticks = [line for line in plan.splitlines() if "Window [lag(tick_ms" in line]
    assert ticks and all("__part" in line for line in ticks)
