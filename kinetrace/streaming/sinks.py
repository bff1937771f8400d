"""A log that takes each micro-batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BatchLog:
    """Sink for ``foreachBatch``: rows go to a folder of their batch, then a record says that it is whole.

    A batch that Spark hands over again, after a failure, is skipped if its
    record is there and written anew if not; readers see batches with a record only.
    So every row is there once, wherever the query was cut off.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def __call__(self, df: DataFrame, batch: int) -> None:
        if self._is_whole(df.sparkSession, batch):
            return
        df.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        self.before_record(batch)
        df.sparkSession.range(1).select(F.lit(batch).cast("long").alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/records/{batch}")

    def before_record(self, batch: int) -> None:
        """A place for tests to fail at."""

    def _is_whole(self, spark: SparkSession, batch: int) -> bool:
        record = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/records/{batch}/_SUCCESS")
        return bool(record.getFileSystem(spark._jsc.hadoopConfiguration()).exists(record))

    def read(self, spark: SparkSession, schema) -> DataFrame:
        """Rows of all whole batches."""
        records = spark.read.schema("batch long").parquet(f"{self.path}/records/*")
        rows = spark.read.schema(schema).parquet(f"{self.path}/rows")
        numbered = rows.withColumn("__batch", F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/", 1).cast("long"))
        return numbered.join(F.broadcast(records.select(F.col("batch").alias("__batch")).distinct()), "__batch", "left_semi").drop("__batch", "batch").select(*(f.name for f in rows.schema if f.name != "batch"))

    def write_csv(self, spark: SparkSession, schema, path: str, order: str) -> None:
        """What is logged so far as CSV, by time."""
        self.read(spark, schema).orderBy(order).write.mode("overwrite").option("header", True).csv(path)
