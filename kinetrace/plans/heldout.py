"""Queries that inject faults, score again and judge: held-out trials and the replay timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.contracts import GT_CONTEXT, SEQUENCE, SEVERITY, STEP, TIME, WINDOW
from ..operators import adaptive, derive, evaluate, inject, resample, score, trials
from ..sources.scratch import materialize
from . import base

#: Faults of the replay in demo mode, in turn.
DEMO_PLAN = [("gyro_bias_drift", "medium"), ("accel_freeze", "medium"), ("clipping", "medium")]
#: Faults that are tried: all that are implemented and not superseded.
TRIED = [k for k in inject.DURATION if k != "clipping"]
PLACEMENTS, SEED, GRACE_S, CONSECUTIVE = 3, 1000, 0.5, 2
#: The test tables move slowly: their motion context is stretched until some of it passes the gates.
STRETCH = {"gt_speed_mps": 1000.0, "gt_vertical_speed_mps": 300.0, "gt_yaw_rate_rps": 300.0}


def scored(df: DataFrame) -> DataFrame:
    return score.trailing_mean_scores(df)


def _rows(spark, d) -> DataFrame:
    return materialize(base.telemetry(spark, d), "sensor-rows")


def _context(spark, d, tel: DataFrame) -> DataFrame:
    """Row number and motion context of each sensor row."""
    context = resample.interpolate(tel.select(SEQUENCE, TIME).distinct(), derive.gt_context(base.ground_truth(spark, d)), GT_CONTEXT, clamp_ends=False)
    return tel.select(SEQUENCE, TIME, STEP).join(context.select(SEQUENCE, TIME, *((F.col(c) * k).alias(c) for c, k in STRETCH.items())), [SEQUENCE, TIME])


def _adaptive(timeline: DataFrame) -> DataFrame:
    return adaptive.adaptive_alerts(materialize(timeline, "timeline"), k=CONSECUTIVE)


def heldout_candidates(spark, d):
    """Places at which each fault is tried: quiet, far apart, in fitting motion."""
    return _places(spark, d, _rows(spark, d))


def _places(spark, d, tel: DataFrame) -> DataFrame:
    clean = materialize(_adaptive(scored(tel)), "clean-timeline")
    return trials.quiet_placements(clean, materialize(_context(spark, d, tel), "motion"), TRIED, PLACEMENTS)


def heldout_smoke(spark, d):
    """Every fault and severity at its places, scored in the segment around it and judged strictly."""
    tel = _rows(spark, d)
    grid = materialize(trials.trial_grid(_places(spark, d, tel), base.lengths(tel), list(SEVERITY)), "trials")
    timeline = materialize(_adaptive(scored(trials.inject_trials(tel, grid, SEED, PLACEMENTS))), "trial-timeline")
    return evaluate.event_eval_strict(timeline, trials.trial_events(grid), grace_s=GRACE_S)


def heldout_smoke_summary(spark, d):
    return evaluate.trial_summary(materialize(heldout_smoke(spark, d), "trial-results"))


def heldout_clean_burden(spark, d):
    return evaluate.clean_burden(_adaptive(scored(base.telemetry(spark, d))), "adaptive")


def anomaly_catalog(spark, d):
    """All faults, made and planned, with how often they were tried and found in the events of the lenient evaluation."""
    from .queries import event_eval_lenient

    tried = event_eval_lenient(spark, d).groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("event_count"), F.avg("event_detected").alias("event_detection_rate"))
    return inject.catalog(spark).join(tried, "anomaly_type", "left").withColumn("event_count", F.coalesce("event_count", F.lit(0).cast("long")))


def replay_timeline(spark, d):
    """The score timeline of each sequence as it is and with three faults in turn; the threshold is always that of the clean one."""
    tel = _rows(spark, d)
    events = inject.demo_schedule(base.lengths(tel), DEMO_PLAN, WINDOW)
    clean = materialize(scored(tel), "clean-timeline")
    threshold = materialize(score.percentile_threshold(clean, 99.0, [SEQUENCE]), "thresholds")
    demo = scored(inject.inject_in_turn(tel, events, DEMO_PLAN, seed=7)).join(events.select(SEQUENCE).distinct(), SEQUENCE, "left_semi")
    none = evaluate.timeline_events(score.annotate(clean, threshold, CONSECUTIVE), events.limit(0)).withColumn("replay_mode", F.lit("clean"))
    some = evaluate.timeline_events(score.annotate(demo, threshold, CONSECUTIVE), events).withColumn("replay_mode", F.lit("demo"))
    return none.unionByName(some).select("replay_mode", SEQUENCE, "window_start_idx", "window_end_idx", TIME, "time_s", "score", "quaternion_score", "gyro_score", "accel_score", "top_group", "threshold", "alert_active", "anomaly_active", "anomaly_type", F.col("anomaly_group").alias("target_group"))


QUERIES = [heldout_candidates, heldout_smoke, heldout_smoke_summary, heldout_clean_burden, anomaly_catalog, replay_timeline]
