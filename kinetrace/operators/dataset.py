"""The stored feature dataset: built per sequence, validated aside, published by manifest, read by manifest.

    <root>/tables/build=<id>/sequence_name=<name>   feature rows of the sequences that a build has made
    <root>/normalizers/build=<id>/artifact=<name>   one JSON file per fold, feature set and mode
    <root>/windows/build=<id>/artifact=<name>       window rows per fold, split, feature set and mode
    <root>/manifests/<id>                           what is valid: a row per sequence, with its build and the hash of its inputs

A build makes only the sequences whose inputs have changed, checks them, and then
writes its manifest; readers follow the latest whole manifest, so they never see a build that is
unfinished or was rejected.  Earlier builds stay until they are cleared.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, norm
from ..functions.contracts import DERIVED, FEATURE_SETS, GT_CONTEXT, MODES, QUATERNION, RAW, SCORE_STRIDE, SEQUENCE, STEP, TIME, TRAIN_STRIDE, WINDOW
from ..sources.scratch import materialize
from . import clean, derive, normalize, resample, windows

COLUMNS = [SEQUENCE, TIME, STEP, *RAW, *DERIVED, *GT_CONTEXT]
MANIFEST = f"{SEQUENCE} string, build string, table_path string, row_count long, step_ns long, timestamp_start_ns long, timestamp_end_ns long, inputs string"
PAYLOAD = "mode string, fitted_sequence_names array<string>, feature_columns array<string>, " + ", ".join(f"{n} map<string, double>" for n in ("center", "means", "medians", "scale", "stds", "iqrs"))
SPLITS = ["train", "validation"]


def artifact_name(fold: Column, feature_set: Column, mode: Column, split: Column | None = None) -> Column:
    """Name of a fold's normalizer, or of a split's windows."""
    return F.concat_ws("_", *([fold] if split is None else [fold, split]), feature_set, mode)


def name_parts(name: Column) -> Column:
    """(fold_name, split_name, feature_set, mode) of an artifact's name; split is null for normalizers, all are null for other names."""
    sets, modes = "|".join(sorted(FEATURE_SETS, key=len, reverse=True)), "|".join(MODES)
    pattern = f"^(fold_[1-9][0-9]*)(?:_(train|validation))?_({sets})_({modes})$"
    part = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    return F.struct(part(1).alias("fold_name"), part(2).alias("split_name"), part(3).alias("feature_set"), part(4).alias("mode"))


def feature_rows(imu: DataFrame, gt: DataFrame, step_ns: int, cutoff_hz: float | None) -> DataFrame:
    """Sensor rows filtered and brought to the grid, with derived features and motion context."""
    on_grid = derive.derive_imu_features(resample.resample(imu.select(SEQUENCE, TIME, *RAW), step_ns, cutoff_hz))
    context = resample.interpolate(on_grid.select(SEQUENCE, TIME), derive.gt_context(gt), GT_CONTEXT, clamp_ends=False)
    return on_grid.join(context, [SEQUENCE, TIME]).select(*COLUMNS)


def input_hashes(imu: DataFrame, gt: DataFrame) -> DataFrame:
    """(sequence, inputs): a hash of all input rows of a sequence, in whatever order."""
    one = lambda df: df.select(SEQUENCE, F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)").alias("h"))
    sums = [one(df).groupBy(SEQUENCE).agg(F.concat_ws("/", F.count(F.lit(1)), F.sum("h")).alias("s")).select(SEQUENCE, F.lit(k).alias("k"), "s") for k, df in enumerate((imu, gt))]
    parts = sums[0].unionByName(sums[1]).groupBy(SEQUENCE)
    return parts.agg(F.concat_ws("|", *(F.coalesce(F.max(F.when(F.col("k") == k, F.col("s"))), F.lit("none")) for k in (0, 1))).alias("inputs"))


def table_violations(tables: DataFrame, step_ns: int) -> DataFrame:
    """(rule, sequence, violations) of stored feature rows, all rules in one pass.

    Rules: rows of another sequence than the folder's (``stored_as``), times that do not rise, steps that
    are not exactly ``step_ns``, quaternions whose length is off by more than 1e-4 and 1e-5 of it, and features that are not finite.
    """
    lag = F.lag(TIME).over(Window.partitionBy("stored_as").orderBy("row"))
    rows = tables.withColumn("row", F.col(STEP)).withColumn("d", F.col(TIME) - lag)
    off = F.abs(norm(*QUATERNION) - 1) > 1e-4 + 1e-5
    rules = {
        "mixed_sequences": ~F.col(SEQUENCE).eqNullSafe(F.col("stored_as")),
        "timestamp_order": F.coalesce(F.col("d") <= 0, F.lit(False)),
        "timestamp_spacing": F.coalesce(F.col("d") != step_ns, F.lit(False)),
        "quaternion_norm": F.coalesce(off, F.lit(True)),
        "non_finite": reduce(lambda a, b: a | b, (finite(c).isNull() for c in RAW + DERIVED)),
    }
    counts = rows.groupBy("stored_as").agg(*(F.count_if(bad).alias(rule) for rule, bad in rules.items()))
    return counts.withColumnRenamed("stored_as", SEQUENCE).unpivot([SEQUENCE], list(rules), "rule", "violations").where("violations > 0")


def missing_columns(df: DataFrame, stored: list[str]) -> list[str]:
    """What is wrong with a table's columns: missing, unexpected, or in another order."""
    found = [f"missing column {c}" for c in stored if c not in df.columns] + [f"unexpected column {c}" for c in df.columns if c not in stored]
    return found or ([] if list(df.columns) == stored else ["columns in another order"])


def expected_artifacts(folds: DataFrame) -> DataFrame:
    """(kind, artifact, train, validation...) of all folds, feature sets and modes."""
    each = normalize.experiments(folds, list(FEATURE_SETS), MODES)
    normalizers = each.withColumns({"kind": F.lit("normalizers"), "split_name": F.lit(None).cast("string"), "artifact": artifact_name(F.col("fold_name"), F.col("feature_set"), F.col("mode"))})
    split = each.withColumn("split_name", F.explode(F.array(*map(F.lit, SPLITS))))
    indexes = split.withColumns({"kind": F.lit("windows"), "artifact": artifact_name(F.col("fold_name"), F.col("feature_set"), F.col("mode"), F.col("split_name"))})
    return normalizers.unionByName(indexes)


def stored_artifacts(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """(kind, artifact): names of the folders that hold files, from the files' paths alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/{kind}").select("path")
    name = F.regexp_extract("path", r"/artifact=([^/]+)/", 1)
    return files.select(F.lit(kind).alias("kind"), name.alias("artifact")).where("artifact <> ''").distinct()


def artifact_violations(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """(rule, kind, artifact): wanted ones that are missing, and stored ones that nobody wants."""
    on = ["kind", "artifact"]
    missing = expected.select(*on).join(stored, on, "left_anti").withColumn("rule", F.lit("missing"))
    return missing.unionByName(stored.join(expected.select(*on), on, "left_anti").withColumn("rule", F.lit("unexpected"))).select("rule", *on)


def write_normalizers(payloads: DataFrame, path: str) -> None:
    """Payload rows with ``artifact`` as JSON, a folder each."""
    payloads.repartition("artifact").write.mode("overwrite").partitionBy("artifact").json(path)


def read_normalizers(spark: SparkSession, path: str) -> DataFrame:
    """(fold_name, feature_set, mode, column_name, center, scale) of stored normalizers of either generation.

    Centers are under center, means or medians, scales under scale, stds or iqrs; a scale of nearly 0 counts as 1.
    """
    stored = spark.read.schema(f"{PAYLOAD}, artifact string").json(path)
    key = name_parts(F.col("artifact"))
    center, scale = F.coalesce("center", "means", "medians"), F.coalesce("scale", "stds", "iqrs")
    absent = F.raise_error(F.concat(F.lit("no centers or scales in "), F.col("artifact"))).cast(PAYLOAD_MAP)
    known = stored.select(key["fold_name"].alias("fold_name"), key["feature_set"].alias("feature_set"), key["mode"].alias("mode"), "feature_columns", F.coalesce(center, absent).alias("c"), F.coalesce(scale, absent).alias("s"))
    each = known.withColumn("column_name", F.explode("feature_columns"))
    s = F.col("s")[F.col("column_name")]
    return each.select("fold_name", "feature_set", "mode", "column_name", F.col("c")[F.col("column_name")].alias("center"), F.when(F.abs(s) <= 1e-12, 1.0).otherwise(s).alias("scale"))


PAYLOAD_MAP = "map<string,double>"


def normalized_by_fold(df: DataFrame, sides: DataFrame, normalizers: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of each fold's sequences, by that fold's normalizers, for all folds in one join.

    ``sides``: fold_name, sequence, feature_set, mode; rows come out per fold, set and mode. A fold without its
    normalizer, or a normalizer without a column, stops the job with the names that are missing.
    """
    key = ["fold_name", "feature_set", "mode"]
    cells = [F.max(F.when(F.col("column_name") == c, F.struct("center", "scale"))).alias(f"__{c}") for c in columns]
    wide = normalizers.groupBy(*key).agg(*cells).withColumn("__found", F.lit(True))
    keyed = sides.join(wide, key, "left")
    missing = F.filter(F.array(F.when(F.col("__found").isNull(), F.lit("all")), *(F.when(F.col("__found") & F.col(f"__{c}").isNull(), F.lit(c)) for c in columns)), lambda x: x.isNotNull())
    told = F.raise_error(F.concat(F.lit("no normalizer of "), F.concat_ws("/", *key), F.lit(" for "), F.array_join("__missing", ", "))).cast("boolean")
    keyed = keyed.withColumn("__missing", missing).where(F.when(F.size("__missing") > 0, told).otherwise(True))
    joined = df.join(keyed, SEQUENCE)
    return joined.select(*key, *(((F.col(c) - F.col(f"__{c}.center")) / F.col(f"__{c}.scale")).alias(c) if c in columns else F.col(c) for c in df.columns))


class FeatureDataset:
    def __init__(self, spark: SparkSession, root: str, step_ns: int = 20_000_000, cutoff_hz: float | None = 20.0):
        self.spark, self.root, self.step_ns, self.cutoff_hz = spark, root.rstrip("/"), step_ns, cutoff_hz

    def builds(self) -> list[int]:
        """Ids of published builds; a manifest counts once Spark has marked it as whole."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        folder = fs_path(f"{self.root}/manifests")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n) for n in names if re.fullmatch(r"\d+", n) and fs.exists(fs_path(f"{self.root}/manifests/{n}/_SUCCESS")))

    def manifest(self) -> DataFrame:
        """The valid sequences; empty before the first build."""
        builds = self.builds()
        return self.spark.read.schema(MANIFEST).json(f"{self.root}/manifests/{builds[-1]}") if builds else self.spark.createDataFrame([], MANIFEST)

    def tables(self, manifest: DataFrame | None = None) -> DataFrame:
        """Feature rows of the manifest's sequences, with ``stored_as``, the folder that they are in.

        Rows of a sequence whose folder lies in another build than the manifest's are not read.
        """
        manifest = self.manifest() if manifest is None else manifest
        rows = self.spark.read.option("basePath", f"{self.root}/tables").parquet(f"{self.root}/tables")
        rows = rows.withColumns({"build": F.col("build").cast("string"), "stored_as": F.col("folder").cast("string")}).drop("folder")
        return rows.join(manifest.select(F.col(SEQUENCE).alias("stored_as"), "build"), ["stored_as", "build"], "left_semi").drop("build")

    def sequence(self, name: str) -> DataFrame:
        """Rows of one sequence; an error if its folder holds any other."""
        rows = self.tables(self.manifest().where(F.col(SEQUENCE) == name))
        wrong = F.raise_error(F.concat(F.lit(f"{name}: holds rows of "), F.coalesce(SEQUENCE, F.lit("null")))).cast("boolean")
        return rows.where(F.when(~F.col(SEQUENCE).eqNullSafe(F.lit(name)), wrong).otherwise(True)).select(*COLUMNS)

    def build(self, imu: DataFrame, gt: DataFrame) -> bool:
        """Bring the dataset up to date with its inputs; False if there was nothing to do."""
        former, hashes = self.manifest(), input_hashes(imu, gt)
        changed = hashes.join(former.select(SEQUENCE, "inputs"), [SEQUENCE, "inputs"], "left_anti")
        gone = former.select(SEQUENCE).join(hashes, SEQUENCE, "left_anti")
        if changed.isEmpty() and gone.isEmpty():
            return False
        build = (self.builds() or [0])[-1] + 1
        path = f"{self.root}/tables/build={build}"
        only = lambda df: df.join(changed.select(SEQUENCE), SEQUENCE, "left_semi")
        fresh = feature_rows(only(imu), only(gt), self.step_ns, self.cutoff_hz)
        fresh.withColumn("folder", F.col(SEQUENCE)).repartition("folder").sortWithinPartitions("folder", STEP).write.mode("overwrite").partitionBy("folder").parquet(path)
        schema = ", ".join(f"{n} {t}" for n, t in fresh.dtypes)  # there are no files if sequences only went
        stored = self.spark.read.schema(f"{schema}, folder string").parquet(path).withColumnRenamed("folder", "stored_as")
        clean.raise_on_violation(table_violations(stored, self.step_ns))
        ends = stored.groupBy(SEQUENCE).agg(F.count(F.lit(1)).alias("row_count"), F.min(TIME).alias("timestamp_start_ns"), F.max(TIME).alias("timestamp_end_ns"))
        table = F.concat(F.lit(f"tables/build={build}/folder="), F.col(SEQUENCE))
        new = ends.join(hashes, SEQUENCE).withColumns({"build": F.lit(str(build)), "table_path": table, "step_ns": F.lit(self.step_ns).cast("long")})
        kept = former.join(hashes, [SEQUENCE, "inputs"], "left_semi")
        names = [f.split()[0] for f in MANIFEST.split(", ")]
        manifest = new.select(*names).unionByName(kept.select(*names))
        manifest.coalesce(1).write.mode("overwrite").json(f"{self.root}/unpublished/{build}")
        manifest = self.spark.read.schema(MANIFEST).json(f"{self.root}/unpublished/{build}")
        self._write_artifacts(manifest, build)
        manifest.coalesce(1).write.mode("overwrite").json(f"{self.root}/manifests/{build}")
        return True

    def _write_artifacts(self, manifest: DataFrame, build: int) -> None:
        """Normalizers and windows of all folds; they change with any sequence."""
        rows, folds = self.tables(manifest), normalize.loso_folds(manifest)
        payloads = []
        every = list(dict.fromkeys(c for columns in FEATURE_SETS.values() for c in columns))
        for mode in MODES:
            fitted = materialize(normalize.fit_folds(rows, folds, every, mode), "fitted")
            for name, columns in FEATURE_SETS.items():
                artifact = artifact_name(F.col("fold_name"), F.lit(name), F.lit(mode))
                payload = normalize.as_payload(fitted.where(F.col("column_name").isin(columns)), folds, columns, mode)
                payloads.append(payload.withColumn("artifact", artifact).drop("fold_name"))
        write_normalizers(reduce(DataFrame.unionByName, payloads), f"{self.root}/normalizers/build={build}")
        split = [windows.fold_windows(folds, windows.window_index(rows, WINDOW, stride)).where(F.col("split_name") == s) for s, stride in (("train", TRAIN_STRIDE), ("validation", SCORE_STRIDE))]
        both = normalize.experiments(split[0].unionByName(split[1]), list(FEATURE_SETS), MODES)
        artifact = artifact_name(F.col("fold_name"), F.col("feature_set"), F.col("mode"), F.col("split_name"))
        both.withColumn("artifact", artifact).repartition("artifact").write.mode("overwrite").partitionBy("artifact").parquet(f"{self.root}/windows/build={build}")

    def violations(self) -> DataFrame:
        """(rule, what, violations) of what is stored: tables, artifacts, normalizers, windows.

        Windows may only name sequences of their side of their fold, and rows that are there at the times they say.
        """
        manifest, build = self.manifest(), (self.builds() or [0])[-1]
        folds, rows = normalize.loso_folds(manifest), self.tables()
        told = lambda df, rule, what, n=F.lit(1): df.select(rule.alias("rule"), what.alias("what"), n.cast("long").alias("violations"))
        out = [told(table_violations(rows, self.step_ns), F.col("rule"), F.col(SEQUENCE), F.col("violations"))]
        names = rows.drop("stored_as").columns
        wrong = missing_columns(rows.drop("stored_as"), [c for c in COLUMNS])
        out += [self.spark.createDataFrame([("columns", w, 1) for w in wrong], "rule string, what string, violations long")] if wrong and names else []
        counts = rows.groupBy("stored_as").agg(F.count(F.lit(1)).alias("n"))
        short = manifest.join(counts.withColumnRenamed("stored_as", SEQUENCE), SEQUENCE, "left").where(F.coalesce("n", F.lit(0)) != F.col("row_count"))
        out.append(told(short, F.lit("row_count"), F.col(SEQUENCE)))
        expected = expected_artifacts(folds)
        for kind in ("normalizers", "windows"):
            bad = artifact_violations(expected.where(F.col("kind") == kind), stored_artifacts(self.spark, f"{self.root}", f"{kind}/build={build}").withColumn("kind", F.lit(kind)))
            out.append(told(bad, F.concat(F.col("rule"), F.lit(f"_{kind}")), F.col("artifact")))
        payloads = self.spark.read.schema(f"{PAYLOAD}, artifact string").json(f"{self.root}/normalizers/build={build}").withColumn("of", name_parts(F.col("artifact")))
        for name, columns in FEATURE_SETS.items():
            for mode in MODES:
                own = payloads.where((F.col("of.feature_set") == name) & (F.col("of.mode") == mode)).withColumn("fold_name", F.col("of.fold_name")).drop("of", "artifact")
                bad = normalize.payload_violations(own, folds, columns, mode)
                out.append(told(bad, F.concat(F.lit("normalizer_"), F.col("rule")), artifact_name(F.col("fold_name"), F.lit(name), F.lit(mode))))
        index = self.spark.read.parquet(f"{self.root}/windows/build={build}")
        sides = folds.select("fold_name", F.explode("train").alias(SEQUENCE), F.lit("train").alias("split_name")).unionByName(folds.select("fold_name", F.col("validation").alias(SEQUENCE), F.lit("validation").alias("split_name")))
        foreign = index.join(sides, ["fold_name", "split_name", SEQUENCE], "left_anti").groupBy("artifact").agg(F.count(F.lit(1)).alias("n"))
        out.append(told(foreign, F.lit("window_sequence"), F.col("artifact"), F.col("n")))
        named = artifact_name(F.col("fold_name"), F.col("feature_set"), F.col("mode"), F.col("split_name"))
        out.append(told(index.where(named != F.col("artifact")).groupBy("artifact").agg(F.count(F.lit(1)).alias("n")), F.lit("window_columns"), F.col("artifact"), F.col("n")))
        bad = windows.window_violations(index, rows).where("violations > 0")
        out.append(told(bad, F.concat(F.lit("window_"), F.col("rule")), F.lit("all"), F.col("violations")))
        return reduce(DataFrame.unionByName, out)
