"""Motion signatures of sequences, and whether a candidate belongs to a cohort."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import in_time, norm
from ..functions.contracts import ACCEL, GYRO, SEQUENCE
from . import profile
from .quantiles import exact_quantiles

KEYS = [
    "gyro_norm_mean", "gyro_norm_std", "gyro_norm_p95", "accel_norm_mean", "accel_norm_std", "accel_norm_p95",
    "dynamic_accel_mean", "dynamic_accel_std", "dynamic_accel_p95", "gyro_delta_std", "accel_delta_std",
]


def motion_signature(df: DataFrame) -> DataFrame:
    """Eleven statistics of each sequence; percentiles are nearest ranks."""
    w = in_time()
    df = df.withColumns({"g": norm(*GYRO), "a": norm(*ACCEL)})
    middle = exact_quantiles(df, [SEQUENCE], "a", [0.5]).select(SEQUENCE, F.col("q")[0].alias("m"))
    df = df.withColumns({"dg": F.col("g") - F.lag("g").over(w), "da": F.col("a") - F.lag("a").over(w)})
    df = df.join(middle, SEQUENCE).withColumn("d", F.abs(F.col("a") - F.col("m")))

    def stats(name: str, c: str):
        return [F.avg(c).alias(f"{name}_mean"), F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(f"{name}_std")]

    ranks = exact_quantiles(df.unpivot([SEQUENCE], ["g", "a", "d"], "name", "value"), [SEQUENCE, "name"], "value", [0.95], nearest=True)
    names = {"g": "gyro_norm", "a": "accel_norm", "d": "dynamic_accel"}
    ranks = ranks.groupBy(SEQUENCE).agg(*(F.max(F.when(F.col("name") == c, F.col("q")[0])).alias(f"{name}_p95") for c, name in names.items()))
    stats_ = df.groupBy(SEQUENCE).agg(*stats("gyro_norm", "g"), *stats("accel_norm", "a"), *stats("dynamic_accel", "d"), F.coalesce(F.stddev_pop("dg"), F.lit(0.0)).alias("gyro_delta_std"), F.coalesce(F.stddev_pop("da"), F.lit(0.0)).alias("accel_delta_std"))
    return stats_.join(ranks, SEQUENCE).select(SEQUENCE, *KEYS)


def zscore_vectors(signatures: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(sequence, key, z): signatures against all sequences; a deviation of 0 counts as 1."""
    long = signatures.unpivot([SEQUENCE], keys, "key", "value")
    stats = long.groupBy("key").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    scale = F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))
    return long.join(stats, "key").select(SEQUENCE, "key", ((F.col("value") - F.col("m")) / scale).alias("z"))


def with_roles(vectors: DataFrame, candidate: Column, reference: Column) -> DataFrame:
    """Vectors with the name of the candidate, the first that fits, and whether a row is the candidate's or a reference's.

    Without a candidate, or with fewer than two references, the job stops with a message.
    """
    fits = lambda c: F.coalesce(c, F.lit(False))
    first = F.min(F.when(fits(candidate), F.struct(F.col(SEQUENCE).alias("name"), fits(reference).cast("int").alias("also"))))
    roles = vectors.agg(first.alias("c"), F.count_distinct(F.when(fits(reference), F.col(SEQUENCE))).alias("n"))
    error = lambda text: F.raise_error(F.lit(text)).cast("string")
    told = F.when(F.col("c").isNull(), error("no candidate")).when(F.col("n") - F.col("c.also") < 2, error("fewer than two references")).otherwise(F.col("c.name"))
    joined = vectors.join(F.broadcast(roles.select(told.alias("candidate"))))
    own = F.col(SEQUENCE) == F.col("candidate")
    return joined.withColumns({"is_candidate": own, "is_reference": fits(reference) & ~own})


def cohort_decision(vectors: DataFrame, candidate: Column, reference: Column) -> DataFrame:
    """The candidate's distance to its references' centre against theirs to the others'."""
    roles = with_roles(vectors, candidate, reference)
    ref = roles.where("is_reference")
    sums = ref.groupBy("key").agg(F.sum("z").alias("total"), F.count(F.lit(1)).alias("n"))
    others = (F.col("total") - F.col("z")) / (F.col("n") - 1)
    own = ref.join(sums, "key").groupBy(SEQUENCE).agg(F.sqrt(F.sum(F.pow(F.col("z") - others, F.lit(2.0)))).alias("d"))
    far = own.agg(F.max("d").alias("max_reference_distance"))
    to_centre = roles.where("is_candidate").join(sums, "key").groupBy("candidate").agg(F.sqrt(F.sum(F.pow(F.col("z") - F.col("total") / F.col("n"), F.lit(2.0)))).alias("candidate_distance"))
    verdict = F.when(F.col("candidate_distance") <= F.col("max_reference_distance"), "merge").otherwise("separate")
    return to_centre.join(far).select("candidate", "candidate_distance", "max_reference_distance", verdict.alias("recommendation"))


def nearest_neighbours(vectors: DataFrame, candidate: Column) -> DataFrame:
    """Other sequences by distance to the candidate."""
    roles = with_roles(vectors, candidate, F.lit(True))
    own = roles.where("is_candidate").select("key", F.col("z").alias("own"))
    others = roles.where("not is_candidate").join(own, "key")
    distance = others.groupBy(SEQUENCE).agg(F.sqrt(F.sum(F.pow(F.col("z") - F.col("own"), F.lit(2.0)))).alias("distance"))
    return distance.withColumn("neighbour_rank", F.row_number().over(Window.orderBy("distance", SEQUENCE)))


def signature_manifest(df: DataFrame, columns: list[str], file_order: str) -> DataFrame:
    """One row per sequence: its times, its missing values and its motion signature."""
    times = profile.timestamp_summary(df, file_order)
    missing = profile.missing_counts(df, columns).groupBy(SEQUENCE).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("column_name", "missing")))).alias("missing"))
    return times.join(missing, SEQUENCE).join(motion_signature(df), SEQUENCE)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
