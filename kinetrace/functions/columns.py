"""Column expressions that operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .contracts import SEQUENCE, TIME


def in_time(*keys: str, order: tuple[str, ...] = (TIME,)):
    """Window over the rows of a sequence in time."""
    return Window.partitionBy(*(keys or (SEQUENCE,))).orderBy(*order)


def norm(*columns: str | Column) -> Column:
    """Euclidean norm."""
    cells = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.sqrt(sum((c * c for c in cells[1:]), cells[0] * cells[0]))


def mean_of(columns: list) -> Column:
    cells = [F.col(c) if isinstance(c, str) else c for c in columns]
    return sum(cells[1:], cells[0]) / len(cells)


def yaw(x: str, y: str, z: str, w: str) -> Column:
    """Yaw of a quaternion."""
    x, y, z, w = map(F.col, (x, y, z, w))
    return F.atan2((w * z + x * y) * 2.0, F.lit(1.0) - (y * y + z * z) * 2.0)


def fold_angle(delta: Column) -> Column:
    """What unwrapping adds for a jump: nothing below pi, else a multiple of two pi."""
    folded = F.pmod(delta + math.pi, F.lit(2 * math.pi)) - math.pi
    folded = F.when((folded == -math.pi) & (delta > 0), math.pi).otherwise(folded)
    return F.when(F.abs(delta) < math.pi, 0.0).otherwise(folded - delta)


def finite(column: str | Column) -> Column:
    """The value, or null if it is NaN or infinite."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def clamp(value: Column, limit: float) -> Column:
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), value))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zero, so that sums compare whatever their order.

    Values are scaled and rounded to a whole number, as in SQL; ``F.round`` goes by
    the shortest decimal, which falls on the other side of some ties.
    """
    scale = 10.0**digits
    one = lambda c: F.when(F.abs(c) < 1e300, F.round(F.col(c) * scale) / scale).otherwise(F.col(c)) + F.lit(0.0)
    return df.select(*(one(f.name).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema))


def platform_hint(name: str | Column) -> Column:
    """Kind of robot by its sequence's name."""
    low = F.lower(F.col(name) if isinstance(name, str) else name)
    return F.when(low.contains("ugv"), "ugv").when(low.contains("legrobot"), "legrobot").when(low.rlike(r"(^|_)rc([0-9_]|$)"), "rc").otherwise("unknown")


def experiment_id(architecture: Column, feature_set: Column, mode: Column, batch: Column, rate: Column, seed: Column) -> Column:
    """One name for an experiment's settings; the rate has one digit and an exponent of two."""
    power = F.floor(F.log10(rate) + F.lit(1e-9)).cast("int")
    digit = F.round(rate / F.pow(F.lit(10.0), power)).cast("int")
    shown = F.concat(digit.cast("string"), F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return F.concat(architecture, F.lit("-"), feature_set, F.lit("-"), mode, F.lit("-bs"), batch.cast("string"), F.lit("-lr"), shown, F.lit("-seed"), seed.cast("string"))


def fold_number(name: Column) -> Column:
    """Number of a fold; the job stops at names that number none, such as fold_0."""
    n = F.regexp_extract(name, r"^fold_(\d+)$", 1).try_cast("int")
    return F.when(n >= 1, n).otherwise(F.raise_error(F.concat(F.lit("no fold: "), name)).cast("int"))


def list_of(text: Column) -> Column:
    """Parts of comma-separated text, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def require_columns(df: DataFrame, names: list[str]) -> None:
    """Raise with the names that are missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
