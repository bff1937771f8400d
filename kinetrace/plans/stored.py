"""Queries that write artifacts, read them back and check them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.contracts import FEATURE_SETS, MODES, RAW, SEQUENCE, STEP, TIME
from ..operators import dataset, normalize
from ..sources.scratch import materialize, shared_folder
from . import base

#: The test tables are sampled every few minutes; the filter's cut-off lies below half of that.
CUTOFF_HZ = 1e-4


def _scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _dataset(spark) -> dataset.FeatureDataset:
    return dataset.FeatureDataset(spark, _scratch(spark, "feature-dataset"), base.GRID_NS, CUTOFF_HZ)


def feature_dataset_manifest(spark, d):
    """The manifest of a whole build: filtered, on the grid, with context, validated, with all folds' artifacts."""
    built = _dataset(spark)
    built.build(materialize(base.telemetry(spark, d), "imu"), materialize(base.ground_truth(spark, d), "gt"))
    return built.manifest().drop("inputs", "build")


def _folds(spark, d):
    return normalize.loso_folds(base.event_times(spark, d))


def normalized_by_fold(spark, d):
    """Validation rows by their folds' stored normalizers, which are of two generations of files."""
    tel, folds, path = materialize(base.telemetry(spark, d), "sensor-rows"), _folds(spark, d), _scratch(spark, "normalizers")
    parts = []
    for mode, (center, scale) in zip(MODES, (("means", "stds"), ("medians", "iqrs")), strict=True):
        payload = normalize.as_payload(normalize.fit_folds(tel, folds, RAW, mode), folds, RAW, mode)
        old = F.col("fold_name").isin("fold_1", "fold_3")
        both = {center: F.when(old, F.col("center")), scale: F.when(old, F.col("scale")), "center": F.when(~old, F.col("center")), "scale": F.when(~old, F.col("scale"))}
        parts.append(payload.select("*").withColumns(both).withColumn("artifact", dataset.artifact_name(F.col("fold_name"), F.lit("raw"), F.lit(mode))).drop("fold_name"))
    dataset.write_normalizers(parts[0].unionByName(parts[1], allowMissingColumns=True), path)
    sides = normalize.experiments(folds.select("fold_name", F.col("validation").alias(SEQUENCE)), ["raw"], MODES)
    return dataset.normalized_by_fold(tel.select(SEQUENCE, TIME, STEP, *RAW), sides, dataset.read_normalizers(spark, path), RAW)


def artifact_matrix(spark, d):
    """Folds times experiments whose file is missing in a store, by the paths of its files."""
    folds, path = _folds(spark, d), _scratch(spark, "artifacts")
    fitted = normalize.fit_folds(base.telemetry(spark, d), folds, RAW, "zscore")
    payload = normalize.experiments(normalize.as_payload(fitted, folds, RAW, "zscore").withColumnRenamed("mode", "fitted_mode"), list(FEATURE_SETS), MODES)
    named = payload.withColumn("artifact", dataset.artifact_name(F.col("fold_name"), F.col("feature_set"), F.col("mode")))
    dataset.write_normalizers(named.where("not (fold_name = 'fold_3' and mode = 'robust')").drop("fitted_mode", "feature_set"), f"{path}/normalizers")
    expected = dataset.expected_artifacts(folds).where("kind = 'normalizers'")
    bad = dataset.artifact_violations(expected, dataset.stored_artifacts(spark, path, "normalizers"))
    return bad.where("rule = 'missing'").select(dataset.name_parts(F.col("artifact")).alias("of")).select("of.fold_name", "of.feature_set", "of.mode")


QUERIES = [feature_dataset_manifest, normalized_by_fold, artifact_matrix]
