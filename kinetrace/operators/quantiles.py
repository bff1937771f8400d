"""Exact quantiles of groups of any size.

An exact percentile aggregate keeps all distinct values of a group in one task.
Here a sketch of fixed size brackets each wanted rank first; a second pass
counts, before any shuffle, what lies below a bracket, and only the values
inside, a few thousandths of a group, are moved and sorted.  Where even those
would be too many for a task, or quantiles leave out one part of a group each,
cells are counted instead, and those that matter parted again (``left_out_quantiles``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize

#: Size of the sketch: a rank is off by at most a share of one over this.
ACCURACY = 2_000
#: Half the width of a bracket, as a share of the ranks.
MARGIN = 4 / ACCURACY
#: Rows of the largest group up to which one bracket is enough: a task sorts a million of them.
ONE_BRACKET = 200_000_000
#: Cells of a group (a power of two), size of their sketch, and rows of a cell that is not parted again.
GRID, CELL_ACCURACY, CELL_ROWS = 512, 5_000, 2_000


def _between(at: Column, low: Column, high: Column) -> Column:
    """The value at a position between two ranks."""
    return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], nearest: bool = False, most: int = ONE_BRACKET) -> DataFrame:
    """(by..., q): an array of the quantiles of ``value`` in the order of ``shares``.

    By linear interpolation between ranks, or the value of the nearest rank from
    above with ``nearest``.  Null values do not count; a group without others has
    no row; NaN is the largest value.  A null key is a key of its own.
    """
    values = df.select(*by, F.col(value).cast("double").alias("__x")).where("__x is not null")
    ends = [p - MARGIN for p in shares] + [p + MARGIN for p in shares]
    asked = F.array(*(F.lit(min(1.0, max(0.0, p))) for p in ends))
    sketch = materialize(values.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__x", asked, ACCURACY).alias("__s")), "rank-sketch")
    if (sketch.agg(F.max("__n")).first()[0] or 0) > most:
        g = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
        whole = left_out_quantiles(values.select(g.alias("g"), F.lit("").alias("part"), F.col("__x").alias("x")), shares, nearest)
        return sketch.select(*by, g.alias("g")).join(whole, "g").select(*by, "q")
    ranges = []
    for k in range(len(shares)):
        # The bracket of a few values holds them all: there a single rank is more than the margin.
        few = F.col("__n") <= ACCURACY
        low = F.when(few | F.lit(ends[k] <= 0), float("-inf")).otherwise(F.col("__s")[k])
        high = F.when(few | F.lit(ends[k + len(shares)] >= 1), float("nan")).otherwise(F.col("__s")[k + len(shares)])
        ranges += [low.alias(f"__low{k}"), high.alias(f"__high{k}")]
    sketch = sketch.select(*(F.col(c).alias(f"__{c}") for c in by), "__n", *ranges)
    # One row without keys; with keys their sketches' size decides how they are joined.
    met = values.join(sketch, [values[c].eqNullSafe(sketch[f"__{c}"]) for c in by]) if by else values.join(F.broadcast(sketch))

    x = F.col("__x")
    cell = [F.struct(F.lit(k).alias("k"), F.lit(p).alias("p"), (x <= F.col(f"__high{k}")).alias("reached"), F.when(x >= F.col(f"__low{k}"), x).alias("v")) for k, p in enumerate(shares)]
    reached = met.select(*by, "__n", F.explode(F.array(*cell)).alias("__c")).where("__c.reached")
    cells = reached.groupBy(*by, "__n", F.col("__c.k").alias("__k"), F.col("__c.p").alias("__p"), F.col("__c.v").alias("__v")).agg(F.count(F.lit(1)).alias("__rows"))
    w = Window.partitionBy(*by, "__k").orderBy(F.asc_nulls_first("__v"))
    position = F.ceil(F.col("__p") * F.col("__n")) - 1 if nearest else F.col("__p") * (F.col("__n") - 1)
    ranked = cells.withColumns({"__upto": F.sum("__rows").over(w), "__at": position})

    def value_at(rank):
        here = F.col("__upto") > rank
        return F.min(F.when(here & F.col("__v").isNull(), F.raise_error(F.lit("a rank lies outside of its bracket")).cast("double")).when(here, F.col("__v")))

    found = ranked.groupBy(*by, "__k").agg(F.max("__at").alias("at"), value_at(F.floor("__at")).alias("low"), value_at(F.ceil("__at")).alias("high"))
    between = _between(F.col("at"), F.col("low"), F.col("high"))
    return found.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("__k").alias("k"), between.alias("q")))), lambda s: s["q"]).alias("q"))


def _grid(values: DataFrame) -> DataFrame:
    """(g, n, b): rows of a group, and some five hundred of its values that part it into shares of about one size."""
    asked = F.array(*(F.lit(i / GRID) for i in range(1, GRID)))
    return materialize(values.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("x", asked, CELL_ACCURACY).alias("b")), "value-grid")


def _in_cells(values: DataFrame, grid: DataFrame) -> DataFrame:
    """``values`` with their cell: 2i between the values i - 1 and i of the grid, 2i + 1 at the value i itself."""
    placed = values.join(grid.select("g", "b"), "g").withColumn("i", F.lit(0))
    for step in (1 << i for i in reversed(range(GRID.bit_length() - 1))):
        # Bisection: i values of the grid are smaller. Each step is a projection of its own, which compiles.
        placed = placed.withColumn("i", F.when(F.get("b", F.col("i") + (step - 1)) < F.col("x"), F.col("i") + step).otherwise(F.col("i")))
    return placed.select("g", "part", "x", (F.col("i") * 2 + F.coalesce(F.get("b", F.col("i")) == F.col("x"), F.lit(False)).cast("int")).alias("cell"))


def _find_cells(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (home, share, end, g, part, rank) with the cell its rank falls into, the rank there, and the cell's size and ends.

    A rank counts the rows of other parts: all rows of a cell less the part's own.
    """
    total = counts.groupBy("g", "cell").agg(F.sum("n").alias("size"), F.min("low").alias("low"), F.max("high").alias("high"))
    own = counts.select("g", "part", "cell", F.col("n").alias("own"))
    each = asked.select("g", "part").distinct().join(total, "g").join(own, ["g", "part", "cell"], "left")
    n = F.col("size") - F.when(F.col("part") == "", 0).otherwise(F.coalesce("own", F.lit(0)))
    upto = F.sum(n).over(Window.partitionBy("g", "part").orderBy("cell"))
    each = each.select("*", upto.alias("upto"), n.alias("others"))
    here = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("others"))
    return asked.join(each, ["g", "part"]).where(here).select("home", "share", "end", "g", "part", (F.col("rank") - F.col("upto") + F.col("others")).alias("rank"), "cell", "size", "low", "high")


def left_out_quantiles(values: DataFrame, shares: list[float], nearest: bool = False, parts: DataFrame | None = None, most: int = CELL_ROWS) -> DataFrame:
    """(g, part, q): for each group and each part of it, quantiles of the group's rows of all *other* parts.

    ``values``: g string, part string, x double.  The part '' is left out of nothing: where it is a group's only part,
    q are the quantiles of the group.  ``parts`` (g, part): the parts to leave out, those of the values by default;
    one without rows leaves out nothing.  A group's grid of values parts it into cells; rows are counted by cell and
    part before any shuffle, a part's ranks are found in the counts of all less its own, and only the cells in which
    a rank falls are looked at again, with a grid of their own, until they have at most ``most`` rows.  So rows are not
    multiplied by parts, and no task gets more of a group than a cell.  Nulls do not count, NaN is the largest value;
    a part without others has no row.
    """
    values = values.where("x is not null")
    found, asked, largest = [], None, most + 1
    while largest > most:
        grid = _grid(values)
        placed = _in_cells(values, grid)
        counts = materialize(placed.groupBy("g", "part", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")), "cell-counts")
        if asked is None:
            asked = _ranks(counts, shares, nearest, parts)
        hits = materialize(_find_cells(counts, asked), "cells-found")
        found.append(hits.where("low <=> high").select("home", "share", "end", "part", F.col("low").alias("value")))
        inner = F.concat("g", F.lit("/"), F.col("cell").cast("string")).alias("g")
        asked = hits.where("not (low <=> high)").select("home", "share", "end", inner, "part", "rank")
        largest = hits.where("not (low <=> high)").agg(F.max("size")).first()[0] or 0
        if not largest:
            break
        wanted = hits.where("not (low <=> high)").select("g", "cell").distinct()
        values = materialize(placed.join(wanted, ["g", "cell"], "left_semi").select(inner, "part", "x"), "cells-wanted")
    else:
        each = values.groupBy("g", "part", "x").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("part", "from")
        met = asked.join(each, "g").where((F.col("from") != F.col("part")) | (F.col("part") == ""))
        keys = ["home", "share", "end", "part"]
        upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("x"))
        found.append(met.withColumn("upto", upto).where("upto > rank").groupBy(*keys).agg(F.min("x").alias("value")))
    both = reduce(DataFrame.unionByName, found).groupBy("home", "part", "share").agg(
        F.max("end.at").alias("at"), F.max(F.when(F.col("end.upper") == 0, F.col("value"))).alias("low"), F.max(F.when(F.col("end.upper") == 1, F.col("value"))).alias("high")
    )
    between = _between(F.col("at"), F.col("low"), F.col("high"))
    return both.groupBy(F.col("home").alias("g"), "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("share", between.alias("q")))), lambda s: s["q"]).alias("q"))


def _ranks(counts: DataFrame, shares: list[float], nearest: bool, parts: DataFrame | None) -> DataFrame:
    """What is asked of the cells: for each group, part and share the ranks on both sides of the wanted position."""
    own = counts.groupBy("g", "part").agg(F.sum("n").alias("own"))
    total = counts.groupBy("g").agg(F.sum("n").alias("total"))
    if parts is not None:
        own = parts.distinct().join(own, ["g", "part"], "left").na.fill(0, ["own"])
    n = F.col("total") - F.when(F.col("part") == "", 0).otherwise(F.col("own"))
    sides = own.join(total, "g").select("g", "part", n.alias("n")).where("n > 0")
    share = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p")) for k, p in enumerate(shares))))
    at = F.greatest(F.lit(0.0), F.ceil(F.col("s.p") * F.col("n")) - 1) if nearest else F.col("s.p") * (F.col("n") - 1)
    each = sides.select("*", share.alias("s")).select("g", "part", F.col("s.k").alias("share"), at.cast("double").alias("at"))
    ends = F.explode(F.array(F.struct("at", F.lit(0).alias("upper")), F.struct("at", F.lit(1).alias("upper"))))
    rank = F.when(F.col("end.upper") == 0, F.floor(F.col("end.at"))).otherwise(F.ceil(F.col("end.at")))
    return each.select("g", "part", "share", ends.alias("end")).select(F.col("g").alias("home"), "share", "end", "g", "part", rank.alias("rank"))
