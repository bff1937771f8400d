"""Queries that fit reconstruction models per fold, and evaluate and rank experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.contracts import RATE_HZ, RAW, SEQUENCE, STEP, TIME, WINDOW
from ..operators import evaluate, inject, models, normalize, score, trials
from ..sources.scratch import materialize
from . import base

SEVERITY, SEED, PERCENT, CONSECUTIVE = "medium", 7, 99.0, 2
#: Rows around an event that are scored again.
MARGIN = 2 * WINDOW
#: Settings of the search: least variance of a component that is kept.
SEARCHED = [0.97, 1.0, 1.05]
GRID = {"architecture": ["pca"], "feature_set": ["raw"], "mode": ["zscore", "robust"], "least_variance": SEARCHED, "percent": [95.0, 99.0]}


def _folds(spark, d) -> DataFrame:
    return normalize.loso_folds(base.event_times(spark, d)).select("fold_name", F.col("validation").alias(SEQUENCE))


def pca_reconstruct(spark, d):
    """Window scores by one model of all sequences."""
    tel = base.telemetry(spark, d)
    found = materialize(models.moments(tel, RAW), "moments")
    model = models.fit(found.select(SEQUENCE).join(F.broadcast(models.total(found, RAW))), RAW)
    return score.window_scores(models.pca_residuals(tel, RAW, model)).select(SEQUENCE, "window_start_idx", "score", "top_group")


def _models(tel: DataFrame, least: float) -> DataFrame:
    return models.fit(models.all_but_own(materialize(models.moments(tel, RAW), "moments"), RAW), RAW, least)


def fold_training(spark, d):
    """A model for each fold: how many components it keeps, and their share of the variance."""
    return _models(base.telemetry(spark, d), models.LEAST_VARIANCE).join(_folds(spark, d), SEQUENCE).select("fold_name", F.col(SEQUENCE).alias("validation"), "kept", "explained")


def _fault_grid(lengths: DataFrame) -> DataFrame:
    """Every fault once in each sequence that is long enough, soon after its first windows."""
    rows = [F.struct(F.lit(k).alias("anomaly_type"), F.lit(i).alias("placement_index"), inject.start_row(F.col("n"), rows_, WINDOW).cast("long").alias("start_index")) for i, (k, rows_) in enumerate(inject.DURATION.items(), 1)]
    places = lengths.where(F.col("n") >= WINDOW).select(SEQUENCE, F.explode(F.array(*rows)).alias("p")).select(SEQUENCE, "p.*")
    return trials.trial_grid(places, lengths, [SEVERITY])


def _faulty(tel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The faults, and the rows around each with the fault written in; they do not depend on a model."""
    grid = materialize(_fault_grid(base.lengths(tel)), "faults")
    changed = trials.inject_trials(tel, grid, seed=SEED, placements=len(inject.DURATION), margin=MARGIN)
    return grid, materialize(changed.withColumn("own", F.substring_index(SEQUENCE, trials.SEPARATOR, 1)), "faulty-rows")


def _breakdown(tel: DataFrame, faulty: tuple[DataFrame, DataFrame], found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The annotated clean timeline, and each fault's event judged leniently.

    Rows are scored one by one, so a fault changes only the windows that it touches: these are
    scored again; the first alert after them is that of the clean timeline.
    """
    grid, changed = faulty
    clean = materialize(score.window_scores(models.pca_residuals(tel, RAW, found)), "clean-timeline")
    threshold = materialize(score.percentile_threshold(clean, PERCENT, [SEQUENCE]), "thresholds")
    annotated = materialize(score.annotate(clean, threshold, CONSECUTIVE), "annotated")
    again = score.window_scores(models.pca_residuals(changed, RAW, found, key="own"))
    limits = threshold.join(grid, SEQUENCE).select(F.concat_ws(trials.SEPARATOR, SEQUENCE, "trial").alias(SEQUENCE), "threshold")
    positive = F.col("score") > F.col("threshold")
    alerts = score.persist(again.join(limits, SEQUENCE).withColumn("positive", F.coalesce(positive, F.lit(False))), "positive", CONSECUTIVE)
    near = alerts.where("alert_active").select(SEQUENCE, F.col(score.INDEX).alias("i"), "top_group")
    after = grid.select(SEQUENCE, "trial", (F.col("end_index") + MARGIN + 1).alias("start_index")).withColumn("event_order", F.col("trial"))
    later = evaluate.next_alerts(annotated, after).select(F.concat_ws(trials.SEPARATOR, SEQUENCE, "event_order").alias(SEQUENCE), "i", F.col("g").alias("top_group")).where("i is not null")
    events = trials.trial_events(grid)
    hits = near.unionByName(later).join(events.select(SEQUENCE, "start_index"), SEQUENCE).where("i >= start_index")
    first = hits.groupBy(SEQUENCE).agg(F.min(F.struct("i", F.col("top_group").alias("g"))).alias("f")).select(SEQUENCE, F.lit(1).alias("event_order"), "f.i", "f.g")
    judged = evaluate.judge_leniently(events, first, int(RATE_HZ))
    return annotated, judged.withColumn("validation", F.substring_index(SEQUENCE, trials.SEPARATOR, 1))


def experiment_breakdown(spark, d):
    """Each fault in each validation sequence."""
    tel = materialize(base.telemetry(spark, d), "sensor-rows")
    return _breakdown(tel, _faulty(tel), materialize(_models(tel, models.LEAST_VARIANCE), "models"))[1].drop(SEQUENCE, "event_order")


def _evaluated(tel: DataFrame, faulty: tuple[DataFrame, DataFrame], folds: DataFrame, least: float) -> DataFrame:
    annotated, judged = _breakdown(tel, faulty, materialize(_models(tel, least), "models"))
    clean = evaluate.clean_summary(annotated, tel.select(SEQUENCE, TIME, STEP))
    return folds.join(clean, SEQUENCE).join(evaluate.injected_summary(judged, ["validation"]).withColumnRenamed("validation", SEQUENCE), SEQUENCE)


def experiment_evaluation(spark, d):
    """Each fold's experiment: threshold and alerts of its clean validation scores, and how it finds the faults."""
    tel = materialize(base.telemetry(spark, d), "sensor-rows")
    return _evaluated(tel, _faulty(tel), _folds(spark, d), models.LEAST_VARIANCE).withColumnRenamed(SEQUENCE, "validation")


def model_search(spark, d):
    """Settings ranked by the means of their folds."""
    tel, folds = materialize(base.telemetry(spark, d), "sensor-rows"), _folds(spark, d)
    faulty, out = _faulty(tel), None
    for least in SEARCHED:
        one = _evaluated(tel, faulty, folds, least).withColumn("experiment_id", F.lit(f"pca-raw-zscore-{least}"))
        out = one if out is None else out.unionByName(one)
    return evaluate.leaderboard(rounded(evaluate.experiment_means(out)))


def search_trials(spark, d):
    """Settings drawn for a search, each with the folds that it is tried on."""
    drawn = models.search_trials(spark, GRID, 16, seed=7)
    return _folds(spark, d).where("fold_name in ('fold_2', 'fold_4')").join(F.broadcast(drawn)).withColumnRenamed(SEQUENCE, "validation")


QUERIES = [pca_reconstruct, fold_training, experiment_breakdown, experiment_evaluation, model_search, search_trials]
