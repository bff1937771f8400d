"""Operators on small inputs with known answers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetrace.functions.columns import platform_hint, require_columns
from kinetrace.functions.contracts import ACCEL, GYRO, QUATERNION, RAW, SEQUENCE, STEP, TIME
from kinetrace.operators import adaptive, clean, cohort, derive, drive, evaluate, inject, models, normalize, profile, resample, score, trials, windows
from kinetrace.sources import files


def frame(spark, rows: int, step_ns: int = 20_000_000, **columns):
    pdf = pd.DataFrame({SEQUENCE: "seq_a", TIME: np.arange(rows) * step_ns, STEP: np.arange(rows)})
    for c in RAW:
        pdf[c] = 0.0
    pdf["q_w"] = 1.0
    for c, v in columns.items():
        pdf[c] = v
    return spark.createDataFrame(pdf)


def column(df, name):
    return [r[0] for r in df.orderBy(TIME).select(name).collect()]


def test_timestamp_summary(spark):
    rows = [("s", t, i) for i, t in enumerate([0, 10**8, 2 * 10**8, 2 * 10**8, 15 * 10**7])]
    r = profile.timestamp_summary(spark.createDataFrame(rows, f"{SEQUENCE} string, {TIME} long, i int"), "i").first()
    assert (r.last_ns, r.duration_s, r.median_step_s, r.rate_hz) == (2 * 10**8, 0.2, 0.1, 10.0)
    assert (r.duplicate_count, r.non_monotonic_count) == (1, 1)


def test_platform_hints(spark):
    names = spark.createDataFrame([("final_UGV1",), ("rc_2",), ("legrobot_a",), ("other",)], "n string")
    assert [r[0] for r in names.select(platform_hint("n")).collect()] == ["ugv", "rc", "legrobot", "unknown"]


def test_required_columns(spark):
    with pytest.raises(ValueError, match="b"):
        require_columns(spark.createDataFrame([(1,)], "a int"), ["a", "b"])


def test_overlap_trim(spark):
    imu = spark.createDataFrame([("s", t) for t in range(100, 600, 100)], f"{SEQUENCE} string, {TIME} long")
    gt = spark.createDataFrame([("s", t) for t in range(250, 650, 100)], f"{SEQUENCE} string, {TIME} long")
    a, b, m = clean.overlap_trim(imu, gt)
    r = m.first()
    assert (r.overlap_start_ns, r.overlap_end_ns, r.imu_rows_before, r.imu_rows_after, r.gt_rows_before, r.gt_rows_after) == (250, 500, 5, 3, 4, 3)
    assert sorted(x[TIME] for x in a.collect()) == [300, 400, 500]


def test_quaternion_signs(spark):
    rng = np.random.default_rng(3)
    q = rng.normal(size=(60, 4))
    q[20] = 0
    want = q.copy()
    for i in range(1, 60):
        if np.dot(want[i - 1], want[i]) < 0:
            want[i] = -want[i]
    df = frame(spark, 60, **{c: q[:, i] for i, c in enumerate(QUATERNION)})
    got = np.array([list(r) for r in clean.repair_quaternion_signs(df).orderBy(TIME).select(*QUATERNION).collect()])
    assert np.allclose(got, want)


def test_low_pass_keeps_slow_and_drops_fast(spark):
    t = np.arange(0, 2, 1 / 200)
    df = frame(spark, len(t), step_ns=5_000_000, lin_acc_x=np.sin(2 * np.pi * 5 * t) + 0.35 * np.sin(2 * np.pi * 35 * t))
    got = np.array(column(resample.low_pass(df), "lin_acc_x"))
    assert np.sqrt(np.mean((got - np.sin(2 * np.pi * 5 * t))[20:-20] ** 2)) < 0.02
    chunked = np.array(column(resample.low_pass(df, chunk_rows=150, halo_rows=120), "lin_acc_x"))
    assert np.abs(got - chunked).max() < 1e-3
    with pytest.raises(ValueError):
        resample.zero_phase(np.zeros((10, 1)), resample.butterworth_sos(4, 20, 200))


def test_resample(spark):
    n = 401
    df = frame(spark, n, step_ns=5_000_000, q_w=np.where(np.arange(n) % 2, -1.0, 1.0))
    out = resample.resample(df.withColumn("lin_acc_x", F.lit(2.0)))
    rows = out.orderBy(TIME).collect()
    assert len(rows) == 101 and all(b[TIME] - a[TIME] == 20_000_000 for a, b in zip(rows, rows[1:], strict=False))
    assert all(abs(r.q_w - 1) < 1e-9 and abs(r.lin_acc_x - 2) < 1e-6 for r in rows)


def test_derived_features(spark):
    k = np.arange(25.0)
    df = frame(spark, 25, ang_vel_x=1 + k, ang_vel_y=2 + k, ang_vel_z=2 + k, lin_acc_x=3 + 5 * k, lin_acc_y=4.0)
    out = derive.derive_imu_features(df)
    assert column(out, "angular_accel_norm")[:2] == pytest.approx([0, math.sqrt(3) / 0.02])
    assert column(out, "jerk_norm")[1] == pytest.approx(5 / 0.02)
    g = np.array(column(out, "gyro_norm"))
    assert column(out, "gyro_rms_local")[24] == pytest.approx(np.sqrt(np.mean(g**2)))


def test_unwrapped_yaw_matches_numpy(spark):
    angles = np.cumsum(np.random.default_rng(1).uniform(-3, 3, 80))
    df = frame(spark, 80).withColumns({c: F.lit(0.0) for c in ("q_w_b_x", "q_w_b_y")})
    pdf = df.toPandas()
    pdf["q_w_b_z"], pdf["q_w_b_w"] = np.sin(angles / 2), np.cos(angles / 2)
    got = column(derive.unwrapped_yaw(spark.createDataFrame(pdf)), "yaw")
    assert got == pytest.approx(list(np.unwrap(np.arctan2(np.sin(angles), np.cos(angles)))), abs=1e-9)


def test_interpolation_bounds(spark):
    source = spark.createDataFrame([("s", 10, 1.0), ("s", 30, 3.0)], f"{SEQUENCE} string, {TIME} long, v double")
    grid = spark.createDataFrame([("s", t) for t in (0, 10, 20, 30, 40)], f"{SEQUENCE} string, {TIME} long")
    assert column(resample.interpolate(grid, source, ["v"], clamp_ends=False), "v") == [None, 1.0, 2.0, 3.0, None]
    assert column(resample.interpolate(grid, source, ["v"], clamp_ends=True), "v") == [1.0, 1.0, 2.0, 3.0, 3.0]


def test_normalizers(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("b", 4.0), ("b", 6.0), ("v", 100.0)], f"{SEQUENCE} string, q_x double")
    train = df.where("sequence_name <> 'v'")
    z, robust = (normalize.fit(train, ["q_x"], m, []).first() for m in ("zscore", "robust"))
    assert (z.center, z.scale) == (3.0, pytest.approx(math.sqrt(5)))
    assert (robust.center, robust.scale) == (3.0, 3.0)
    flat = normalize.fit(df.withColumn("q_x", F.lit(7.0)), ["q_x"], "zscore", []).first()
    assert flat.scale == 1.0
    with pytest.raises(ValueError):
        normalize.fit(df, ["q_x"], "other", [])


def test_window_index(spark):
    rows = windows.window_index(frame(spark, 400), 150, 50).orderBy("start_row").collect()
    assert [r.start_row for r in rows] == [0, 50, 100, 150, 200, 250]
    assert all(r.end_timestamp_ns - r.start_timestamp_ns == 149 * 20_000_000 for r in rows)
    assert windows.window_index(frame(spark, 100), 150, 50).isEmpty()


def test_top_mean_and_threshold(spark):
    values = [0.0] * 142 + [16.0] * 8
    df = spark.createDataFrame([(values,)], "v array<double>")
    assert df.select(score.top_mean(F.col("v"), 8)).first()[0] == 16.0
    scores = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.3, 0.4)], "score double")
    assert score.percentile_threshold(scores, 75).first()[0] == pytest.approx(0.325)


def timeline(spark, scores, onset_at=()):
    rows = [("s", 5 * i, 5 * i + 149, (5 * i + 149) * 20_000_000, i * 0.1, float(x), "accel") for i, x in enumerate(scores)]
    return spark.createDataFrame(rows, f"{SEQUENCE} string, window_start_idx long, window_end_idx long, {TIME} long, time_s double, score double, top_group string")


def test_persistence_and_segments(spark):
    annotated = score.annotate(timeline(spark, [0, 9, 9, 9, 0, 9, 9]), spark.createDataFrame([(5.0,)], "threshold double"), 2)
    rows = annotated.orderBy("window_end_idx").collect()
    assert [r.alert_active for r in rows] == [False, False, True, True, False, False, True]
    assert [r.alert_onset for r in rows] == [False, False, True, False, False, False, True]
    segments = score.alert_segments(annotated).orderBy("segment_id").collect()
    assert [(s.row_count, s.duration_s) for s in segments] == [(2, 0.2), (1, 0.1)]


def test_adaptive_alerts_match_a_plain_fold(spark):
    rng = np.random.default_rng(2)
    scores = np.concatenate([rng.uniform(1, 1.2, 40), rng.uniform(5, 6, 10), rng.uniform(1, 1.2, 30)])
    got = adaptive.adaptive_alerts(timeline(spark, scores), k=2).orderBy("window_end_idx").toPandas()
    baseline, scale, active, history = [], [], [], []
    for i, x in enumerate(scores):
        if active and active[-1]:
            b, s = baseline[-1], scale[-1]
        else:
            past = scores[max(0, i - 300) : i]
            b = np.median(past) if len(past) else x
            mad = np.median(np.abs(past - b)) if len(past) else 0
            s = max(1.4826 * mad, 1e-6, 0.05 * max(abs(b), 1e-6))
        history.append((x - b) / s > 5 and x > b)
        baseline.append(b)
        scale.append(s)
        active.append(len(history) >= 2 and all(history[-2:]))
    assert got["alert_active"].tolist() == active and any(active)
    assert got["baseline"].to_numpy() == pytest.approx(np.array(baseline))


def test_strict_evaluation(spark):
    annotated = score.annotate(timeline(spark, [0.0] * 5 + [9.0] * 6 + [0.0] * 5), spark.createDataFrame([(5.0,)], "threshold double"), 2)
    event = spark.createDataFrame([("s", 1, "accel_freeze", "medium", "accel", 170, 209)], f"{SEQUENCE} string, event_order int, anomaly_type string, severity string, target_group string, start_index long, end_index long")
    r = evaluate.event_eval_strict(annotated, event).first()
    assert r.event_detected_strict == 1.0 and r.alert_trigger_group == "accel" and r.group_attribution_correct == 1.0
    assert r.time_to_detect_s == pytest.approx((149 + 5 * 6 - 170) / 50)
    assert r.outside_event_alert_onset_count == 0


def test_spacing(spark):
    rows = [("s", 90, 1.0, 1.0), ("s", 100, 1.5, 1.0), ("s", 30, 2.0, 1.0), ("s", 60, 3.0, 1.0)]
    df = spark.createDataFrame(rows, f"{SEQUENCE} string, start_index long, region_max_score double, baseline_score double")
    assert [r.start_index for r in evaluate.spaced_out(df, 2, 40).orderBy("choice").collect()] == [90, 30]


def test_injection(spark):
    ramp = np.arange(200.0)
    df = frame(spark, 200, lin_acc_x=ramp, ang_vel_x=ramp, lin_acc_y=1.0)
    frozen = column(inject.inject(df, "gyro_freeze", "medium", 60), "ang_vel_x")
    assert frozen[60:100] == [60.0] * 40 and frozen[100] == 100.0
    assert column(inject.inject(df, "packet_dropout", "large", 80), "ang_vel_x")[80:100] == [79.0] * 20
    assert column(inject.inject(df, "sensor_lag", "medium", 100), "lin_acc_x")[100] == 92.0
    turned = inject.inject(df, "gyro_accel_inconsistency", "medium", 100)
    assert column(turned, "ang_vel_x") == list(ramp) and column(turned, "lin_acc_y")[100] != 1.0
    again = [column(inject.inject(df, "noise_burst", "small", 50, seed=4), "lin_acc_x") for _ in range(2)]
    assert again[0] == again[1] and again[0][50:70] != list(ramp[50:70])
    idle = df.withColumns({"gt_speed_mps": F.lit(0.0), "gt_vertical_speed_mps": F.lit(0.0), "gt_yaw_rate_rps": F.lit(0.0)})
    with pytest.raises(ValueError, match="motion"):
        inject.inject(idle, "impact_pulse", "medium", 50)
    with pytest.raises(ValueError, match="unknown"):
        inject.inject(df, "nothing", "medium", 50)


def test_motion_signature(spark):
    df = frame(spark, 10, ang_vel_x=3.0, ang_vel_y=4.0, lin_acc_z=10.0)
    r = cohort.motion_signature(df).first()
    assert (r.gyro_norm_mean, r.accel_norm_mean, r.dynamic_accel_mean, r.gyro_delta_std) == (5.0, 10.0, 0.0, 0.0)


def test_fold_models_are_those_of_the_other_rows(spark):
    """Total less own: the same means, scales and projectors as numpy's on the other sequences."""
    rng = np.random.default_rng(3)
    mixing = rng.normal(size=(10, 10))
    parts = {name: (rng.normal(size=(60 + 20 * k, 10)) @ mixing + k)[:, :] for k, name in enumerate("abc")}
    df = spark.createDataFrame([(name, *map(float, row)) for name, rows in parts.items() for row in rows], ", ".join([f"{SEQUENCE} string", *(f"{c} double" for c in RAW)]))
    found = {r[SEQUENCE]: r for r in models.fit(models.all_but_own(models.moments(df, RAW), RAW), RAW).collect()}
    for name in parts:
        x = np.concatenate([rows for other, rows in parts.items() if other != name])
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        values, vectors = np.linalg.eigh(z.T @ z / len(z))
        axes = vectors[:, values > 1]
        assert np.allclose(found[name].mean, x.mean(axis=0)) and np.allclose(found[name].scale, x.std(axis=0))
        assert np.allclose(np.array(found[name].projector).reshape(10, 10), axes @ axes.T, atol=1e-7) and found[name].kept == axes.shape[1]
    scored = models.pca_residuals(df, RAW, models.fit(models.all_but_own(models.moments(df, RAW), RAW), RAW))
    own = scored.where(f"{SEQUENCE} = 'a'").select(*(f"r_{c}" for c in RAW)).toPandas().to_numpy()
    m = found["a"]
    z = (parts["a"] - np.array(m.mean)) / np.array(m.scale)
    assert np.allclose(np.sort(own.sum(axis=1)), np.sort(((z - z @ np.array(m.projector).reshape(10, 10)) ** 2).sum(axis=1)))
    alone = df.where(f"{SEQUENCE} = 'a'")
    assert models.fit(models.all_but_own(models.moments(alone, RAW), RAW), RAW).count() == 0


def test_command_shim():
    shim = drive.CommandShim()
    assert shim.tick(0.05, 1.0, 1.0, 0.5, 1.0, 0.0) == (0.0, 0.0, 0.0)
    raw, steer, _ = shim.tick(0.05, 0.0, 0.25, 0.9, 0.0, 0.0)
    assert raw == pytest.approx(-(0.25 / drive.VISUAL_MPS_PER_RAW + 0.6 * 0.25 + 0.15 * 0.25 * 0.05)) and steer == 0.6


def test_files(spark, tmp_path):
    import zipfile

    header = "timestamp, q_x, q_y, q_z, q_w, ang_vel_x, ang_vel_y, ang_vel_z, lin_acc_x, lin_acc_y, lin_acc_z\n"
    (tmp_path / "imu.csv").write_text(header + "200, 0, 0, 0, 1, 1, 2, 3, 4, 5, 6\n100, 0, 0, 0, 1, 1, 2, 3, 4, 5, 6\n")
    imu = files.read_imu_csv(spark, str(tmp_path / "imu.csv"), "run")
    assert imu.columns == [SEQUENCE, TIME, *RAW] and column(imu, TIME) == [100, 200]
    with zipfile.ZipFile(tmp_path / "gt.zip", "w") as z:
        z.writestr("x/run_ground_truth_path.csv", "timestamp,p_w_b_x,p_w_b_y,p_w_b_z,q_w_b_x,q_w_b_y,q_w_b_z,q_w_b_w\n5,1,2,3,0,0,0,1\n")
    assert files.read_gt_zip(spark, str(tmp_path / "gt.zip"), "run").first().p_w_b_z == 3.0
    files.write_by_sequence(imu, str(tmp_path / "out"))
    assert files.read_sequence(spark, str(tmp_path / "out"), "run").count() == 2
    assert GYRO and ACCEL
    files.write_manifest(spark.createDataFrame([("a", float("inf"), [1, 2])], "n string, x double, l array<int>"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m/json")).columns == ["l", "n"]


def test_trials_are_single_injections(spark):
    rng = np.random.default_rng(6)
    df = frame(spark, 300, **{c: rng.normal(size=300) for c in RAW})
    places = spark.createDataFrame([("seq_a", k, p, 150 + 40 * p) for k in inject.DURATION for p in (1, 2)], f"{SEQUENCE} string, anomaly_type string, placement_index int, start_index long")
    grid = trials.trial_grid(places, df.groupBy(SEQUENCE).agg(F.count(F.lit(1)).alias("n")), ["small", "large"])
    rows = trials.inject_trials(df, grid, seed=3, placements=2, margin=1000).toPandas()
    for t in grid.collect():
        got = rows[rows[SEQUENCE] == f"seq_a#{t.trial}"].sort_values(STEP)
        want = inject.inject(df, t.anomaly_type, t.severity, t.start_index, seed=3 + t.placement_index).orderBy(STEP).toPandas()
        assert np.allclose(got[RAW].to_numpy(), want[RAW].to_numpy()), t


def test_faults_in_turn_are_rewrites_one_after_the_other(spark):
    """Overlapping faults: each reads, and is scaled by, what the ones before have left; a sequence without events stays."""
    rng = np.random.default_rng(8)
    df = frame(spark, 200, **{c: rng.normal(size=200) for c in RAW})
    other = df.withColumn(SEQUENCE, F.lit("seq_b"))
    plan = [("accel_bias_drift", "large"), ("packet_dropout", "small"), ("accel_freeze", "small"), ("clipping", "small"), ("noise_burst", "large")]
    starts = [60, 90, 100, 110, 120]
    events = spark.createDataFrame([("seq_a", k, s) for k, s in enumerate(starts, 1)], f"{SEQUENCE} string, event_order int, start_index long")
    got = inject.inject_in_turn(df.unionByName(other), events, plan, seed=5)
    want = df
    for k, ((kind, severity), start) in enumerate(zip(plan, starts, strict=True)):
        want = spark.createDataFrame(inject.inject(want, kind, severity, start, seed=5 + k).toPandas(), want.schema)
    pairs = [(got.where(f"{SEQUENCE} = 'seq_a'"), want), (got.where(f"{SEQUENCE} = 'seq_b'"), other)]
    for mine, theirs in pairs:
        assert np.allclose(*(x.orderBy(STEP).toPandas()[RAW].to_numpy() for x in (mine, theirs)))


def test_quiet_places_keep_their_distance_and_fit_the_motion(spark):
    timeline = spark.createDataFrame([("s", 5 * k, 5 * k + 149, float(abs(k - 150)), 200 <= k < 230) for k in range(400)], f"{SEQUENCE} string, window_start_idx long, window_end_idx long, score double, alert_active boolean")
    rows = spark.range(2149).select(F.lit("s").alias(SEQUENCE), F.col("id").alias(STEP), F.lit(0.0).alias("gt_speed_mps"), F.lit(0.0).alias("gt_vertical_speed_mps"), F.when(F.col("id") < 1500, 1.0).otherwise(0.0).alias("gt_yaw_rate_rps"))
    got = {(r.anomaly_type, r.placement_index): r.start_index for r in trials.quiet_placements(timeline, rows, ["gyro_bias_step", "impact_pulse", "angular_rate_burst"], 3, gap=200).collect()}
    kinds = {k for k, _ in got}
    assert kinds == {"gyro_bias_step", "angular_rate_burst"}  # a pulse needs speed
    for kind in kinds:
        mine = [got[k, p] for k, p in sorted(got) if k == kind]
        assert len(mine) >= 2 and all(abs(a - b) >= 200 for i, a in enumerate(mine) for b in mine[:i]) and max(mine) < 1500
        assert not any(1000 - 149 - 150 - inject.DURATION[kind] - 150 <= s <= 1298 + 150 and s + inject.DURATION[kind] + 150 >= 1000 for s in mine)


def test_names(spark):
    from kinetrace.functions.columns import fold_number, list_of

    df = spark.createDataFrame([("fold_12", " a, ,b")], "f string, l string")
    assert tuple(df.select(fold_number(F.col("f")), list_of(F.col("l"))).first()) == (12, ["a", "b"])
    with pytest.raises(Exception, match="no fold"):
        df.select(fold_number(F.lit("fold_0"))).collect()


def test_roles_by_hint(spark):
    from kinetrace.functions.columns import platform_hint
    from kinetrace.operators import cohort

    rows = [(n, k, v) for n, v in (("ugv_a", 0.0), ("ugv_b", 1.0), ("ugv_c", 2.0), ("rc_2", 9.0), ("rc_1", 1.0)) for k in ("x", "y")]
    df = spark.createDataFrame(rows, f"{SEQUENCE} string, key string, z double")
    rc, ugv = platform_hint(SEQUENCE) == "rc", platform_hint(SEQUENCE) == "ugv"
    r = cohort.cohort_decision(df, rc, ugv).first()
    assert (r.candidate, r.candidate_distance, r.recommendation) == ("rc_1", 0.0, "merge")
    assert [x[SEQUENCE] for x in cohort.nearest_neighbours(df, rc).orderBy("neighbour_rank").collect()] == ["ugv_b", "ugv_a", "ugv_c", "rc_2"]
    for candidate, reference, words in ((F.lit(False), ugv, "no candidate"), (rc, F.col(SEQUENCE) == "ugv_a", "fewer than two")):
        with pytest.raises(Exception, match=words):
            cohort.cohort_decision(df, candidate, reference).collect()


def test_trim_without_overlap_and_first_parts(spark):
    imu, gt = (spark.createDataFrame([("s", t) for t in times], f"{SEQUENCE} string, {TIME} long") for times in ((0, 10, 20), (30, 40)))
    with pytest.raises(Exception, match="no overlap in s"):
        clean.overlap_trim(imu, gt)[0].collect()
    df = frame(spark, 300)
    assert clean.first_seconds(df, 2.0).count() == 101 and clean.first_rows(df, 250).count() == 250


def test_pose_csv(spark, tmp_path):
    (tmp_path / "gt.csv").write_text("timestamp,p_w_b_x,p_w_b_y,p_w_b_z,q_w_b_x,q_w_b_y,q_w_b_z,q_w_b_w\n7,1,2,3,0,0,0,1\n")
    row = files.read_gt_csv(spark, str(tmp_path / "gt.csv"), "run").first()
    assert (row[SEQUENCE], row[TIME], row.p_w_b_y, row.q_w_b_w) == ("run", 7, 2.0, 1.0)
    (tmp_path / "bad.csv").write_text("timestamp,p_w_b_x\n7,1\n")
    with pytest.raises(ValueError, match="missing columns"):
        files.read_gt_csv(spark, str(tmp_path / "bad.csv"), "run")
