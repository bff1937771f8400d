"""The stored feature dataset: built, read, built again, spoilt and validated."""

import glob
import json
import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.functions.contracts import FEATURE_SETS, GT_POSITION, GT_QUATERNION, MODES, RAW, SEQUENCE, STEP, TIME
from kinetrace.operators import dataset, normalize

STEP_NS = 20_000_000


def inputs(spark, names=("seq_a", "seq_b", "seq_c"), shift=0.0):
    """Four seconds of each sequence at 100 Hz, poses at 25 Hz."""
    rng = np.random.default_rng(5)
    imu, gt = [], []
    for name in names:
        moved = rng.normal(size=(400, 6)).cumsum(axis=0) / 10
        for k in range(400):
            q = np.array([0.1, 0.2, 0.3, 1.0])
            imu.append((name, 10_000_000 * k, *map(float, q / np.linalg.norm(q)), *(float(x + (shift if name == "seq_b" else 0.0)) for x in moved[k])))
            if k % 4 == 0:
                gt.append((name, 10_000_000 * k, k / 100, k / 200, 0.0, 0.0, 0.0, 0.0, 1.0))
    columns = lambda names: ", ".join(f"{c} double" for c in names)
    return spark.createDataFrame(imu, f"{SEQUENCE} string, {TIME} long, {columns(RAW)}"), spark.createDataFrame(gt, f"{SEQUENCE} string, {TIME} long, {columns(GT_POSITION + GT_QUATERNION)}")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("built") / "set")
    assert dataset.FeatureDataset(spark, root, STEP_NS).build(*inputs(spark))
    return root


def copy(built, tmp_path):
    return str(shutil.copytree(built, tmp_path / "set"))


def found(spark, root):
    return {(r.rule, r.what): r.violations for r in dataset.FeatureDataset(spark, root, STEP_NS).violations().collect()}


def test_whole_build_is_valid(spark, built):
    d = dataset.FeatureDataset(spark, built, STEP_NS)
    assert {r[SEQUENCE]: (r.row_count, r.timestamp_start_ns, r.timestamp_end_ns) for r in d.manifest().collect()} == {n: (200, 0, 199 * STEP_NS) for n in ("seq_a", "seq_b", "seq_c")}
    assert d.sequence("seq_b").count() == 200 and d.sequence("seq_b").columns == dataset.COLUMNS
    assert found(spark, built) == {}
    expected = dataset.expected_artifacts(normalize.loso_folds(d.manifest()))
    assert expected.where("kind = 'normalizers'").count() == 3 * 4 and expected.where("kind = 'windows'").count() == 3 * 4 * 2
    fits = dataset.read_normalizers(spark, f"{built}/normalizers/build=1")
    assert fits.count() == 3 * 2 * (10 + 16) and fits.where("center is null or scale is null").count() == 0


def test_only_changed_sequences_are_built_again(spark, built, tmp_path):
    root = copy(built, tmp_path)
    before = {p: os.path.getmtime(p) for p in glob.glob(f"{root}/**/*.*", recursive=True)}
    d = dataset.FeatureDataset(spark, root, STEP_NS)
    assert not d.build(*inputs(spark))
    assert {p: os.path.getmtime(p) for p in glob.glob(f"{root}/**/*.*", recursive=True)} == before
    assert d.build(*inputs(spark, shift=1.0))
    assert {r[SEQUENCE]: r.build for r in d.manifest().collect()} == {"seq_a": "1", "seq_b": "2", "seq_c": "1"}
    assert os.listdir(f"{root}/tables/build=2")[0:] and not os.path.exists(f"{root}/tables/build=2/folder=seq_a")
    assert d.tables().count() == 600 and found(spark, root) == {}
    imu, gt = inputs(spark, shift=1.0)
    assert d.build(imu.where(f"{SEQUENCE} <> 'seq_c'"), gt.where(f"{SEQUENCE} <> 'seq_c'"))
    assert sorted(r[SEQUENCE] for r in d.manifest().collect()) == ["seq_a", "seq_b"] and found(spark, root) == {}


def test_unfinished_builds_are_not_read(spark, built, tmp_path):
    root = copy(built, tmp_path)
    shutil.copytree(f"{root}/manifests/1", f"{root}/manifests/2")
    os.remove(f"{root}/manifests/2/_SUCCESS")
    assert dataset.FeatureDataset(spark, root).builds() == [1]
    imu, gt = inputs(spark)
    rejected = imu.withColumn("q_w", F.when((F.col(TIME) == 1_000_000_000) & (F.col(SEQUENCE) == "seq_a"), float("nan")).otherwise(F.col("q_w")))
    with pytest.raises(Exception, match="non_finite|quaternion_norm"):
        dataset.FeatureDataset(spark, root, STEP_NS, None).build(rejected, gt)
    assert dataset.FeatureDataset(spark, root).builds() == [1]


def spoil(spark, root, name, change):
    path = f"{root}/tables/build=1/folder={name}"
    rows = spark.createDataFrame(change(spark.read.parquet(path)).toPandas())
    shutil.rmtree(path)
    rows.coalesce(1).write.parquet(path)


@pytest.mark.parametrize(
    ("rule", "change"),
    [
        ("timestamp_spacing", lambda t: t.withColumn(TIME, F.col(TIME) + F.when(F.col(STEP) == 10, 1_000_000).otherwise(0))),
        ("quaternion_norm", lambda t: t.withColumn("q_w", F.when(F.col(STEP) == 15, 0.2).otherwise(F.col("q_w")))),
        ("timestamp_order", lambda t: t.withColumn(TIME, F.when(F.col(STEP) == 10, 0).otherwise(F.col(TIME)))),
        ("mixed_sequences", lambda t: t.withColumn(SEQUENCE, F.when(F.col(STEP) == 3, "seq_z").otherwise(F.col(SEQUENCE)))),
        ("non_finite", lambda t: t.withColumn("jerk_norm", F.when(F.col(STEP) == 3, float("inf")).otherwise(F.col("jerk_norm")))),
    ],
)
def test_spoilt_rows_are_named(spark, built, tmp_path, rule, change):
    root = copy(built, tmp_path)
    spoil(spark, root, "seq_a", change)
    assert found(spark, root).get((rule, "seq_a"), 0) >= 1
    if rule == "mixed_sequences":
        with pytest.raises(Exception, match="holds rows of seq_z"):
            dataset.FeatureDataset(spark, root).sequence("seq_a").count()


def test_spoilt_artifacts_are_named(spark, built, tmp_path):
    root = copy(built, tmp_path)
    shutil.rmtree(f"{root}/normalizers/build=1/artifact=fold_2_raw_robust")
    shutil.rmtree(f"{root}/windows/build=1/artifact=fold_1_train_raw_zscore")
    os.makedirs(f"{root}/windows/build=1/artifact=fold_9_train_raw_zscore")
    shutil.copy(glob.glob(f"{root}/windows/build=1/artifact=fold_3_train_raw_zscore/*.parquet")[0], f"{root}/windows/build=1/artifact=fold_9_train_raw_zscore/x.parquet")
    (file,) = glob.glob(f"{root}/normalizers/build=1/artifact=fold_1_raw_zscore/*.json")
    payload = json.load(open(file))
    json.dump(payload | {"mode": "robust", "fitted_sequence_names": ["seq_z"], "center": {}}, open(file, "w"))
    os.remove(os.path.join(os.path.dirname(file), "." + os.path.basename(file) + ".crc"))
    got = found(spark, root)
    assert {("missing_normalizers", "fold_2_raw_robust"), ("missing_windows", "fold_1_train_raw_zscore"), ("unexpected_windows", "fold_9_train_raw_zscore"), ("window_columns", "fold_9_train_raw_zscore")} <= set(got)
    assert {("normalizer_mode", "fold_1_raw_zscore"), ("normalizer_provenance", "fold_1_raw_zscore"), ("normalizer_center", "fold_1_raw_zscore")} <= set(got)


def test_missing_normalizers_and_columns_are_told(spark, built):
    fits = dataset.read_normalizers(spark, f"{built}/normalizers/build=1")
    rows = dataset.FeatureDataset(spark, built).tables().drop("stored_as")
    sides = spark.createDataFrame([("fold_1", "seq_a", "raw", "zscore")], f"fold_name string, {SEQUENCE} string, feature_set string, mode string")
    assert dataset.normalized_by_fold(rows, sides, fits, FEATURE_SETS["raw"]).count() == 200
    for change, words in ((fits.where("fold_name <> 'fold_1'"), "fold_1/raw/zscore for all"), (fits.where("column_name <> 'q_x'"), "fold_1/raw/zscore for q_x")):
        with pytest.raises(Exception, match=words):
            dataset.normalized_by_fold(rows, sides, change, FEATURE_SETS["raw"]).count()


def test_columns_are_checked_by_name_and_order():
    assert dataset.missing_columns(_Columns("a", "b"), ["a", "b"]) == []
    assert dataset.missing_columns(_Columns("b", "a"), ["a", "b"]) == ["columns in another order"]
    assert dataset.missing_columns(_Columns("a", "c"), ["a", "b"]) == ["missing column b", "unexpected column c"]


class _Columns:
    def __init__(self, *names):
        self.columns = list(names)


def test_names_of_artifacts(spark):
    df = spark.createDataFrame([("fold_12_validation_raw_plus_derived_robust",), ("fold_1_raw_zscore",), ("fold_0_raw_zscore",), ("other",)], "a string")
    assert [tuple(r) for r in df.select(dataset.name_parts(F.col("a")).alias("p")).select("p.*").collect()] == [("fold_12", "validation", "raw_plus_derived", "robust"), ("fold_1", None, "raw", "zscore"), (None, None, None, None), (None, None, None, None)]
    assert MODES == ["zscore", "robust"]
