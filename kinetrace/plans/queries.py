"""All telemetry queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import experiment_id, platform_hint, rounded
from ..functions.contracts import ACCEL, DERIVED, GT_CONTEXT, GT_POSITION, GT_QUATERNION, GYRO, QUATERNION, RAW, SCORE_STRIDE, SEQUENCE, STEP, TIME, TRAIN_STRIDE, WINDOW
from ..operators import adaptive, blocks, clean, cohort, derive, drive, evaluate, inject, normalize, profile, qa, resample, score, windows
from ..sources import files
from ..sources.scratch import materialize
from . import base, experiments, heldout, live, stored

Query = Callable[[SparkSession, str], DataFrame]
START_ROW, SEVERITY_USED = 100, "medium"
KEYS = [SEQUENCE, TIME, STEP]
PLAN = [("gyro_bias_drift", "medium"), ("accel_freeze", "medium"), ("clipping", "medium")]


def telemetry_base(spark, d):
    return base.telemetry(spark, d)


def derived_features(spark, d):
    return derive.derive_imu_features(base.telemetry(spark, d)).select(*KEYS, *DERIVED)


def window_index(spark, d):
    tel = base.telemetry(spark, d)
    return windows.window_index(tel, WINDOW, TRAIN_STRIDE).unionByName(windows.window_index(tel, WINDOW, SCORE_STRIDE))


def _timeline(spark, d):
    return score.trailing_mean_scores(base.telemetry(spark, d))


def window_scores(spark, d):
    return _timeline(spark, d).select(SEQUENCE, "window_start_idx", "window_end_idx", TIME, "time_s", "score")


def group_scores(spark, d):
    return _timeline(spark, d).select(SEQUENCE, "window_start_idx", "quaternion_score", "gyro_score", "accel_score", "top_group")


def _stored_timeline(spark, d):
    """The timeline, written once for queries that read it several times."""
    return materialize(_timeline(spark, d), "timeline")


def score_threshold(spark, d):
    timeline = materialize(_timeline(spark, d).select(SEQUENCE, "score"), "scores")
    return score.percentile_thresholds(timeline, [50.0, 90.0, 99.0], [SEQUENCE])


def _annotated(spark, d, percent=90.0, k=2):
    timeline = _stored_timeline(spark, d)
    return score.annotate(timeline, score.percentile_threshold(timeline, percent), k)


def alert_timeline(spark, d):
    return _annotated(spark, d).select(SEQUENCE, "window_start_idx", "window_end_idx", "score", "threshold", "positive", "alert_active", "alert_onset")


def alert_segments(spark, d):
    return score.alert_segments(_annotated(spark, d))


def _raw_events(spark, d):
    return base.event_times(spark, d).select(SEQUENCE, TIME, "event_id", F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("value").cast("string")).alias("value"), F.when(F.col("event_id") % 11 != 0, F.col("props")).alias("props"))


def timestamp_summary(spark, d):
    return profile.timestamp_summary(base.event_times(spark, d), "event_id")


def csv_profile(spark, d):
    return profile.csv_profile(_raw_events(spark, d), ["value", "props"], "event_id")


def missing_counts(spark, d):
    return profile.missing_counts(_raw_events(spark, d), ["value", "props"])


def platform_hints(spark, d):
    return base.table(spark, d, "customer").select("c_custkey", platform_hint(F.concat(F.element_at(F.array(F.lit("Urban_UGV"), F.lit("legrobot_"), F.lit("rc_"), F.lit("search_")), (F.col("c_custkey") % 4 + 1).cast("int")), F.col("c_custkey"))).alias("platform"))


def raw_manifest(spark, d):
    names = F.array(*map(F.lit, ["imu_data.csv", "run_gt.zip", "run_folder.zip", "calibration.yaml", "notes.txt"]))
    suppliers = base.table(spark, d, "supplier").select(F.concat(F.lit("run_"), F.col("s_nationkey")).alias(SEQUENCE), F.element_at(names, (F.col("s_suppkey") % 5 + 1).cast("int")).alias("file"))
    wanted = base.table(spark, d, "nation").select(F.concat(F.lit("run_"), F.col("n_nationkey")).alias(SEQUENCE))
    return profile.raw_manifest(suppliers, wanted)


def overlap_trim(spark, d):
    return clean.overlap_trim(base.telemetry(spark, d), base.ground_truth(spark, d))[2]


def order_violations(spark, d):
    return clean.order_violations(base.event_times(spark, d), "event_id")


def null_violations(spark, d):
    tel = base.telemetry(spark, d)
    holes = {c: F.when(F.col("event_id") % m != 0, F.col(c)) for c, m in zip(ACCEL, (5, 7, 11), strict=True)}
    return clean.null_violations(tel.withColumns(holes), RAW)


def _flipped(spark, d):
    tel = base.telemetry(spark, d)
    sign = F.when(F.col("event_id") % 3 == 0, -1.0).otherwise(1.0)
    return tel.withColumns({c: F.col(c) * sign for c in QUATERNION})


def quaternion_sign_repair(spark, d):
    return clean.repair_quaternion_signs(_flipped(spark, d)).select(*KEYS, *QUATERNION)


def quaternion_norm_check(spark, d):
    tel = base.telemetry(spark, d)
    return clean.norm_violations(tel.withColumn("q_w", F.when(F.col("event_id") % 13 == 0, F.col("q_w") * 1.01).otherwise(F.col("q_w"))))


def clean_validation(spark, d):
    return clean.clean_validation(base.telemetry(spark, d), base.ground_truth(spark, d), RAW, GT_POSITION + GT_QUATERNION, GT_QUATERNION)


def uniform_grid(spark, d):
    return resample.uniform_grid(base.telemetry(spark, d), base.GRID_NS)


def interp_imu(spark, d):
    tel = base.telemetry(spark, d)
    return resample.interpolate(resample.uniform_grid(tel, base.GRID_NS), tel, GYRO + ACCEL, clamp_ends=True)


def gt_context_native(spark, d):
    return derive.gt_context(base.ground_truth(spark, d))


def gt_context_aligned(spark, d):
    grid = resample.uniform_grid(base.telemetry(spark, d), base.GRID_NS)
    return resample.interpolate(grid, derive.gt_context(base.ground_truth(spark, d)), GT_CONTEXT, clamp_ends=False)


def yaw_unwrap_simple(spark, d):
    rows = base.drive_rows(spark, d).withColumnRenamed("t", TIME)
    return derive.unwrap_by_steps(rows, "yaw", ("run",)).select("run", TIME, "yaw", "yaw_unwrapped")


def source_rate(spark, d):
    return resample.source_rate(base.telemetry(spark, d)).select(SEQUENCE, (F.col("source_rate_hz") * 1e6).alias("source_rate_uhz"))


def _feature_table(spark, d):
    tel = base.telemetry(spark, d)
    grid = resample.uniform_grid(tel, base.GRID_NS)
    imu = resample.renormalize(resample.interpolate(grid, clean.repair_quaternion_signs(tel), RAW, clamp_ends=True))
    imu = derive.derive_imu_features(blocks.numbered(materialize(imu, "on-grid"), [SEQUENCE], TIME, [TIME], STEP))
    gt = resample.interpolate(grid, derive.gt_context(base.ground_truth(spark, d)), GT_CONTEXT, clamp_ends=False)
    return imu.join(gt, [SEQUENCE, TIME]).select(*KEYS, *RAW, *DERIVED, *GT_CONTEXT)


def feature_table(spark, d):
    return _feature_table(spark, d)


def lowpass_fir(spark, d):
    return resample.low_pass_fir(base.telemetry(spark, d), GYRO + ACCEL).select(*KEYS, *GYRO, *ACCEL)


def lowpass_butterworth(spark, d):
    tel = base.telemetry(spark, d)
    return resample.low_pass(tel, cutoff_hz=1e-4).select(*KEYS, *GYRO, *ACCEL)


def _folds(spark, d):
    return normalize.loso_folds(base.event_times(spark, d))


def loso_folds(spark, d):
    folds = normalize.experiments(_folds(spark, d), ["raw", "raw_plus_derived"], ["zscore", "robust"])
    return folds.select("fold_name", F.array_join("train", ",").alias("train"), "validation", "feature_set", "mode")


def normalizer_zscore(spark, d):
    return normalize.fit_folds(base.telemetry(spark, d), _folds(spark, d), RAW, "zscore")


def normalizer_robust(spark, d):
    # Read several times: for the grid of values, the counts of cells, and the cells that matter.
    return normalize.fit_folds(materialize(base.telemetry(spark, d), "sensor-rows"), _folds(spark, d), RAW, "robust")


def normalizer_full_dev(spark, d):
    tel = base.telemetry(spark, d)
    return normalize.fit(tel, RAW, "zscore", []).withColumn("mode", F.lit("zscore")).unionByName(normalize.fit(tel, RAW, "robust", []).withColumn("mode", F.lit("robust")))


def normalized_windows(spark, d):
    tel = base.telemetry(spark, d)
    scaled = normalize.apply(tel, normalize.fit(tel, RAW, "zscore", []), RAW)
    arrays = windows.window_arrays(scaled, windows.window_index(tel, WINDOW, TRAIN_STRIDE), RAW)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return arrays.select(SEQUENCE, "start_row", F.size("rows").alias("row_count"), total(F.transform("rows", lambda r: r[0])).alias("sum_q_x"), total(F.transform("rows", lambda r: r[9])).alias("sum_lin_acc_z"))


def _fold_windows(spark, d):
    return windows.fold_windows(_folds(spark, d), windows.window_index(base.telemetry(spark, d), WINDOW, TRAIN_STRIDE))


def window_dedup(spark, d):
    return windows.last_fold_wins(_fold_windows(spark, d).where("split_name = 'train'"))


def tail_split(spark, d):
    return windows.tail_split(windows.window_index(base.telemetry(spark, d), WINDOW, TRAIN_STRIDE))


def window_index_validation(spark, d):
    tel = base.telemetry(spark, d)
    index = windows.window_index(tel, WINDOW, TRAIN_STRIDE)
    broken = index.withColumns({"start_timestamp_ns": F.when(F.col("start_row") % 100 == 0, F.col("start_timestamp_ns") + 1).otherwise(F.col("start_timestamp_ns")), "end_row": F.when(F.col("start_row") % 150 == 0, F.col("end_row") + 100000).otherwise(F.col("end_row"))})
    return windows.window_violations(broken, tel)


def _long_features(spark, d):
    df = materialize(_feature_table(spark, d), "features")
    return df, RAW + DERIVED + GT_CONTEXT


def sequence_feature_stats(spark, d):
    return qa.sequence_feature_stats(*_long_features(spark, d))


def fold_window_counts(spark, d):
    return qa.fold_window_counts(_fold_windows(spark, d))


def _drift(spark, d):
    df, columns = _long_features(spark, d)
    return qa.feature_drift(df, _folds(spark, d), columns)


def feature_drift(spark, d):
    return _drift(spark, d)


def top_drift(spark, d):
    w = Window.orderBy(F.desc(F.round("standardized_mean_difference", 6)), "fold_name", "feature_name")
    return _drift(spark, d).withColumn("drift_rank", F.row_number().over(w)).where("drift_rank <= 5").select("drift_rank", "fold_name", "feature_name", "standardized_mean_difference")


def qa_summary(spark, d):
    return qa.qa_summary(sequence_feature_stats(spark, d), _drift(spark, d))


def _signatures(spark, d):
    return cohort.motion_signature(base.telemetry(spark, d))


def motion_signature(spark, d):
    return _signatures(spark, d)


def zscore_vectors(spark, d):
    return cohort.zscore_vectors(_signatures(spark, d))


def cohort_decision(spark, d):
    """The first sequence by name against all others."""
    return cohort.cohort_decision(materialize(cohort.zscore_vectors(_signatures(spark, d)), "vectors"), F.lit(True), F.lit(True))


def nearest_neighbours(spark, d):
    return cohort.nearest_neighbours(materialize(cohort.zscore_vectors(_signatures(spark, d)), "vectors"), F.lit(True))


def signature_manifest(spark, d):
    """Times, missing values and motion signature of each sequence, with nested counts as JSON."""
    tel = base.telemetry(spark, d)
    read = {f"read_{c}": F.when(F.col("event_id") % m != 0, F.col(c)) for c, m in zip(ACCEL[:2], (5, 7), strict=True)}
    return files.flat(cohort.signature_manifest(tel.withColumns(read), list(read), "event_id"))


def injected(kind, spark, d):
    return inject.inject(base.telemetry(spark, d), kind, SEVERITY_USED, START_ROW, seed=7).select(*KEYS, *RAW)


def robust_scale(spark, d):
    tel = base.telemetry(spark, d)
    return inject.robust_scale(tel, GYRO).withColumn("group_name", F.lit("gyro")).unionByName(inject.robust_scale(tel, ACCEL).withColumn("group_name", F.lit("accel")))


def motion_gate(spark, d):
    context = derive.gt_context(base.ground_truth(spark, d)).withColumns({"gt_speed_mps": F.col("gt_speed_mps") * 1000, "gt_vertical_speed_mps": F.col("gt_vertical_speed_mps") * 300, "gt_yaw_rate_rps": F.col("gt_yaw_rate_rps") * 300})
    return context.select(SEQUENCE, TIME, *(inject.motion_gates(k).alias(k) for k in ("gyro_bias_step", "impact_pulse", "angular_rate_burst", "sensor_lag")))


def demo_schedule(spark, d):
    return inject.demo_schedule(base.lengths(base.telemetry(spark, d)), PLAN, 100)


def _events(spark, d):
    """Two events in each sequence, a third and two thirds into it."""
    n = base.lengths(base.event_times(spark, d))
    rows = [F.struct(F.lit(k).alias("event_order"), F.lit(kind).alias("anomaly_type"), F.lit("medium").alias("severity"), F.lit(group).alias("target_group"), F.expr(f"n * {k} div 3").cast("long").alias("start_index")) for k, kind, group in ((1, "gyro_bias_step", "gyro"), (2, "accel_freeze", "accel"))]
    df = n.select(SEQUENCE, F.explode(F.array(*rows)).alias("e")).select(SEQUENCE, "e.*")
    return df.withColumn("end_index", F.col("start_index") + 49)


def clean_summary(spark, d):
    return evaluate.clean_summary(_annotated(spark, d), base.event_times(spark, d))


def clean_burden(spark, d):
    return evaluate.clean_burden(_annotated(spark, d), "global")


def event_eval_lenient(spark, d):
    return evaluate.event_eval_lenient(_annotated(spark, d), _events(spark, d))


def event_eval_strict(spark, d):
    return evaluate.event_eval_strict(_annotated(spark, d), _events(spark, d))


def timeline_events(spark, d):
    return evaluate.timeline_events(_timeline(spark, d), _events(spark, d)).select(SEQUENCE, "window_start_idx", "anomaly_active", "anomaly_type", "severity", "anomaly_group")


def _quiet(spark, d):
    return evaluate.quiet_segments(_annotated(spark, d, 97.0), base.lengths(base.event_times(spark, d)), 40, 25)


def quiet_segments(spark, d):
    return _quiet(spark, d)


def quiet_segments_nms(spark, d):
    return evaluate.spaced_out(materialize(_quiet(spark, d), "quiet-places"), 3, 300)


def trial_summary(spark, d):
    return evaluate.trial_summary(event_eval_strict(spark, d))


def injected_summary(spark, d):
    return evaluate.injected_summary(event_eval_lenient(spark, d), ["anomaly_type"])


def experiment_ids(spark, d):
    """Names of experiments: architecture, features, normalization, batch, rate, seed."""
    li = base.table(spark, d, "supplier").select("s_suppkey", F.element_at(F.array(F.lit("lstm"), F.lit("tcn")), (F.col("s_suppkey") % 2 + 1).cast("int")).alias("architecture"), F.element_at(F.array(F.lit(3e-4), F.lit(1e-3)), (F.col("s_suppkey") % 2 + 1).cast("int")).alias("rate"))
    return li.select("s_suppkey", experiment_id(F.col("architecture"), F.lit("raw"), F.lit("zscore"), F.lit(64), F.col("rate"), F.col("s_suppkey") % 10).alias("experiment_id"))


def normalizer_validation(spark, d):
    """A fold's normalizers against its training sequences and columns; two are spoilt on purpose."""
    folds = _folds(spark, d)
    fitted = normalize.fit_folds(base.telemetry(spark, d), folds, RAW, "zscore")
    stored = normalize.as_payload(fitted, folds, RAW, "zscore")
    spoilt = stored.withColumns({"mode": F.when(F.col("fold_name") == "fold_1", "robust").otherwise(F.col("mode")), "feature_columns": F.when(F.col("fold_name") == "fold_2", F.slice("feature_columns", 1, 9)).otherwise(F.col("feature_columns"))})
    return normalize.payload_violations(spoilt, folds, RAW, "zscore")


def leaderboard(spark, d):
    """Suppliers stand for experiments, line items for their folds, which are added up by row groups of the files."""
    stored, pieces = ["file_path", "row_index"], ["file_path", "file_block_start"]
    with files.small_splits(spark):
        li = base.table(spark, d, "lineitem")
        folds = li.select(*(f"_metadata.{c}" for c in (*stored, pieces[1])), F.col("l_suppkey").alias("experiment_id"), (1 - F.col("l_discount")).alias("event_detection_rate"), F.when(F.col("l_linenumber") < 4, F.col("l_quantity") / 10).otherwise(float("inf")).alias("median_time_to_detect_s"), F.col("l_tax").alias("clean_alerts_per_min"), (F.col("l_quantity") / 50).alias("group_attribution_top1"))
        means = evaluate.experiment_means(folds, stored, pieces=pieces)
    return evaluate.leaderboard(rounded(means))


def adaptive_baseline(spark, d):
    return score.adaptive_baseline(_stored_timeline(spark, d)).select(SEQUENCE, "window_end_idx", "score", "trailing_median", "trailing_mad")


def adaptive_alerts(spark, d):
    return adaptive.adaptive_alerts(_stored_timeline(spark, d), k=2, z=2.0).select(SEQUENCE, "window_end_idx", "baseline", "scale", "normalized_score", "positive", "alert_active", "alert_onset")


def odom_normalize(spark, d):
    tel = base.telemetry(spark, d).withColumns({"vx": F.col("lin_acc_x"), "vy": F.col("lin_acc_y"), "vz": F.col("lin_acc_z")})
    return drive.normalize_odometry(tel).select(*KEYS, *QUATERNION, "vx", "vy", "vz")


def phase_speed_metrics(spark, d):
    return drive.phase_speed_metrics(base.drive_rows(spark, d))


def speed_fit(spark, d):
    return drive.speed_fit(base.drive_rows(spark, d), "x", "y", ["phase"])


def drive_summary(spark, d):
    return drive.drive_summary(base.drive_rows(spark, d), "run", straight="1", arc="2", stop="5")


def asof_clock(spark, d):
    events = base.event_times(spark, d).select(SEQUENCE, TIME, "event_id", "value")
    rows = events.where("event_id % 3 <> 0").select(SEQUENCE, TIME, "event_id")
    clock = events.where("event_id % 3 = 0").select(SEQUENCE, TIME, F.col("event_id").alias("clock_id"), F.col("value").alias("clock_value"))
    return drive.as_of(rows, clock, SEQUENCE, TIME, ["clock_id", "clock_value"])


def phase_labels(spark, d):
    phases = spark.createDataFrame([("start", 0.0, 1000.0), ("middle", 1000.0, 8000.0), ("end", 8000.0, 1e12)], "phase_name string, phase_start double, phase_end double")
    return drive.label_phases(base.drive_rows(spark, d).select("run", "t"), phases).groupBy("run", "phase_name").agg(F.count(F.lit(1)).alias("row_count"), F.min("t").alias("first_t"))


def listing_parse(spark, d):
    """Lines of an object store's listing, made from nations and regions."""
    n = base.table(spark, d, "nation").select(F.concat(F.lit("   PRE "), F.col("n_name"), F.lit("/")).alias("value"))
    r = base.table(spark, d, "region").select(F.concat(F.lit("2024-01-01 10:00:00   123 "), F.regexp_replace("r_name", " ", "_"), F.lit(".csv")).alias("value"))
    return files.parse_listing(n.unionByName(r))


def manifest_upsert(spark, d):
    old = base.table(spark, d, "nation").select(F.concat(F.lit("run_"), F.col("n_nationkey")).alias(SEQUENCE), F.lit(1).alias("version"))
    new = base.table(spark, d, "region").select(F.concat(F.lit("run_"), F.col("r_regionkey") * 10).alias(SEQUENCE), F.lit(2).alias("version"))
    return files.upsert_manifest(old, new)


def queries() -> dict[str, Query]:
    plain = [
        telemetry_base, derived_features, window_index, window_scores, group_scores, score_threshold, alert_timeline, alert_segments,
        timestamp_summary, csv_profile, missing_counts, platform_hints, raw_manifest, listing_parse, manifest_upsert,
        overlap_trim, order_violations, null_violations, quaternion_sign_repair, quaternion_norm_check, clean_validation,
        uniform_grid, interp_imu, gt_context_native, gt_context_aligned, yaw_unwrap_simple, source_rate, feature_table, lowpass_fir, lowpass_butterworth,
        loso_folds, normalizer_zscore, normalizer_robust, normalizer_full_dev, normalized_windows, window_dedup, tail_split, window_index_validation,
        sequence_feature_stats, fold_window_counts, feature_drift, top_drift, qa_summary, motion_signature, zscore_vectors, cohort_decision, nearest_neighbours, signature_manifest,
        robust_scale, motion_gate, demo_schedule, clean_summary, clean_burden, event_eval_lenient, event_eval_strict, timeline_events,
        quiet_segments, quiet_segments_nms, trial_summary, experiment_ids, normalizer_validation, injected_summary, leaderboard, adaptive_baseline, adaptive_alerts,
        odom_normalize, phase_speed_metrics, speed_fit, drive_summary, asof_clock, phase_labels,
        *experiments.QUERIES, *stored.QUERIES, *live.QUERIES, *heldout.QUERIES,
    ]
    found: dict[str, Query] = {f.__name__: _rounded(f) for f in plain}
    return found | {f"inject_{kind}": _rounded(partial(injected, kind)) for kind in inject.DURATION}


def _rounded(query: Query) -> Query:
    return lambda spark, sf_dir: rounded(query(spark, sf_dir))
