"""Sources and sinks: raw CSV and zip files, contract tables, manifests."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import require_columns
from ..functions.contracts import GT_POSITION, GT_QUATERNION, RAW, SEQUENCE, TIME

GT_MEMBER = "ground_truth_path.csv"
#: Bytes of a split that holds one row group of a Parquet file where these are not smaller.
SPLIT_BYTES = 1 << 20


@contextmanager
def small_splits(spark: SparkSession) -> Iterator[None]:
    """Files are read in splits of SPLIT_BYTES, whatever the cores, in jobs that run inside.

    Spark reads a row group with the split in which its middle lies, so ``_metadata.file_block_start``
    then tells row groups apart that are not smaller.
    """
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(SPLIT_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _contract(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Trim header names, check and order columns, rename the time stamp, add the sequence."""
    df = df.toDF(*(c.strip() for c in df.columns))
    require_columns(df, ["timestamp", *columns])
    return df.select(F.lit(name).alias(SEQUENCE), F.trim(F.col("timestamp")).cast("long").alias(TIME), *(F.trim(F.col(c)).cast("double").alias(c) for c in columns))


def read_imu_csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Canonical sensor rows of a raw file whose header has spaces."""
    return _contract(spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path), name, RAW)


def read_gt_csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    return _contract(spark.read.option("header", True).csv(path), name, GT_POSITION + GT_QUATERNION)


def read_gt_zip(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Poses from the first member of a zip file that ends like the ground truth's."""
    columns = ["timestamp", *GT_POSITION, *GT_QUATERNION]

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    member = next((n for n in z.namelist() if n.endswith(GT_MEMBER)), None)
                    if member is None:
                        raise ValueError(f"no member ends with {GT_MEMBER}")
                    rows = pd.read_csv(z.open(member), dtype=str)
                    yield rows.rename(columns=str.strip)[columns]

    text = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"{c} string" for c in columns))
    return _contract(text, name, GT_POSITION + GT_QUATERNION)


def write_by_sequence(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy(SEQUENCE).parquet(path)


def read_sequence(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One sequence of a partitioned table; only its folder is read."""
    return spark.read.parquet(path).where(F.col(SEQUENCE) == name)


def list_sequences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(SEQUENCE).distinct().orderBy(SEQUENCE)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, as CSV needs."""
    return df.select(*(F.to_json(n).alias(n) if t.startswith(("array", "map", "struct")) else F.col(n) for n, t in df.dtypes))


def null_unless_finite(df: DataFrame) -> DataFrame:
    """NaN and infinities as null, as JSON needs."""
    return df.select(*(F.when(~F.isnan(n) & (F.abs(n) < float("inf")), F.col(n)).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes))


def write_manifest(df: DataFrame, path: str) -> None:
    """A small table as JSON and CSV."""
    null_unless_finite(df).coalesce(1).write.mode("overwrite").json(f"{path}/json")
    flat(df).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def upsert_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` replace those of the same sequence."""
    return old.join(new.select(SEQUENCE), SEQUENCE, "left_anti").unionByName(new).orderBy(SEQUENCE)


def parse_listing(lines: DataFrame) -> DataFrame:
    """(kind, name) of the lines of an object store's listing: prefixes and files."""
    line = F.trim("value")
    prefix = line.startswith("PRE ")
    name = F.when(prefix, F.regexp_replace(F.trim(F.expr("substring(trim(value), 5)")), "/$", "")).otherwise(F.element_at(F.split(line, r"\s+"), -1))
    return lines.where(line != "").select(F.when(prefix, "prefix").otherwise("file").alias("kind"), name.alias("name"))
