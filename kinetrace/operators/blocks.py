"""Windows over parts of a sequence, so that no task holds or sorts a whole one.

Rows are parted by time or by row number.  A frame of a bounded number of rows gets copies of
the rows just outside of its part; a value that runs from a sequence's start comes into a part as one more row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of all sequences together in a stretch of time, and of one sequence in a part by row number.
TIME_ROWS, PART_ROWS = 100_000, 20_000
PART, OWN = "__part", "__own"


def by_time(df: DataFrame, time: str, like: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """``df`` with PART: stretches of time of one length, of which as many are made as ``like`` (or ``df``) has times ``rows`` rows; times that are null go first."""
    span = (df if like is None else like).agg(F.min(time).alias("__a"), F.max(time).alias("__b"), F.count(F.lit(1)).alias("__n"))
    length = (F.col("__b") - F.col("__a")) / F.ceil(F.col("__n") / (rows or TIME_ROWS))
    span = span.select("__a", F.when(length > 0, length).otherwise(1.0).alias("__length"))
    part = F.floor((F.col(time) - F.col("__a")) / F.col("__length"))
    return df.join(F.broadcast(span)).withColumn(PART, F.coalesce(part, F.lit(-1).cast("long"))).drop("__a", "__length")


def numbered(df: DataFrame, keys: list[str], time: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: the row number inside ``keys``, from 0, by ``order``, which begins with ``time``.

    A part's first number is the count of the rows in the parts before.
    """
    parted = by_time(df, time)
    counts = parted.groupBy(*keys, PART).agg(F.count(F.lit(1)).alias("__count"))
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(*keys, PART, F.coalesce(F.sum("__count").over(earlier), F.lit(0)).alias("__first"))
    both = parted.unionByName(firsts, allowMissingColumns=True)
    w = Window.partitionBy(*keys, PART).orderBy(F.col("__first").isNull(), *order)
    both = both.withColumns({name: (F.row_number().over(w) - 2 + F.first("__first").over(w)).cast("long")})
    return both.where("__first is null").select(*df.columns, name)


def with_halo(df: DataFrame, number: str, before: int, after: int = 0, rows: int | None = None) -> DataFrame:
    """``df`` with PART by ``number`` and OWN; a part also holds copies of the rows up to ``before`` ahead of its own and ``after`` behind them."""
    rows = rows or PART_ROWS
    at = F.col(number)
    part = lambda c: F.floor(c / rows)
    near = F.sequence(F.greatest(part(at - after), F.lit(0).cast("long")), part(at + before))
    return df.withColumn(PART, F.explode(near)).withColumn(OWN, F.col(PART) == part(at))


def own(df: DataFrame) -> DataFrame:
    """The rows that are no copies."""
    return df.where(OWN).drop(PART, OWN)


def carried(df: DataFrame, keys: list[str], row: Column, key: Column, last: bool = True) -> DataFrame:
    """(keys..., PART, c): for each part of ``df`` the ``row`` with the largest ``key`` in the parts before, or with the smallest in those behind; null rows do not count."""
    pick = F.max_by(row, F.when(row.isNotNull(), key)) if last else F.min_by(row, F.when(row.isNotNull(), key))
    ends = df.groupBy(*keys, PART).agg(pick.alias("c"))
    w = Window.partitionBy(*keys).orderBy(F.asc(PART) if last else F.desc(PART)).rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(*keys, PART, F.last("c", ignorenulls=True).over(w).alias("c")).where("c is not null")
