"""Resharding by minimum-cost flow.

Old shards supply bytes, new shards have capacities; a byte that stays costs
nothing, a byte that moves costs one.  The flow of least cost says how many
bytes go from which old shard to which new one.  Each old shard is divided into
blocks by hash; whole blocks are transferred, and only a block in which a flow
ends is divided between its rows, by where a row's middle lies.

Law ``bytes``: shards are equal in bytes up to the rows at the ends of flows.
Equal texts carry no constraint: a group of copies may be larger than a shard.

The shards that gain or lose rows are then written anew (``rewrite_affected``): texts
move once, to tasks of some hundred MB, of which a shard has as many as it needs.

Defined results: a null text has no bytes and costs the overhead alone; a text
of any length is one row; a null
in the old layout is a shard of its own, -1; repeated rows are placed each, with
a slot of their own; more shards than rows leave shards empty; other columns are
written as they are, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict, deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bytes that a row costs besides its text; blocks of an old shard: at least, at most, and bytes beyond which there are more.
OVERHEAD, BLOCKS, MOST_BLOCKS, BLOCK_BYTES = 16, 512, 4096, 4 << 30
#: Bytes of a shard's files.
FILE_BYTES = 256 << 20


def near_equal(total: int, shards: int) -> list[int]:
    """Capacities that add up to ``total`` and differ by one at most."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def min_cost_transfers(supply: dict[int, int], capacity: dict[int, int]) -> dict[tuple[int, int], int]:
    """Bytes from old to new shards that fill the capacities and move least.

    Successive shortest paths over old shards, new shards and residual arcs; a
    graph with one node per shard, however large the table is.
    """
    if sum(supply.values()) > sum(capacity.values()):
        raise ValueError("the new capacities do not hold the old shards")
    left, room = dict(supply), dict(capacity)
    flow: dict[tuple[int, int], int] = defaultdict(int)
    for i in left:  # arcs of cost 0 are always on a shortest path
        if (stay := min(left[i], room.get(i, 0))) > 0:
            flow[i, i] += stay
            left[i] -= stay
            room[i] -= stay
    while any(left.values()):
        cost = {("old", i): 0 for i in left if left[i]}
        came: dict = {}
        queue = deque(cost)
        while queue:
            side, k = node = queue.popleft()
            if side == "old":
                ahead = [(("new", j), cost[node] + (j != k)) for j in room]
            else:
                ahead = [(("old", i), cost[node] - (i != k)) for i in supply if flow.get((i, k), 0) > 0]
            for to, price in ahead:
                if price < cost.get(to, 1 << 60):
                    cost[to], came[to] = price, node
                    queue.append(to)
        end = min((n for n in cost if n[0] == "new" and room[n[1]] > 0), key=lambda n: (cost[n], n[1]))
        path = [end]
        while path[-1] in came:
            path.append(came[path[-1]])
        path.reverse()
        steps = list(zip(path, path[1:], strict=False))
        amount = min([left[path[0][1]], room[end[1]], *(flow[b[1], a[1]] for a, b in steps if a[0] == "new")])
        for a, b in steps:
            if a[0] == "old":
                flow[a[1], b[1]] += amount
            else:
                flow[b[1], a[1]] -= amount
        left[path[0][1]] -= amount
        room[end[1]] -= amount
    return {arc: n for arc, n in flow.items() if n > 0}


def divide_blocks(blocks: list[tuple[int, int, int]], transfers: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int, int]]:
    """(old shard, block, from byte, to byte, new shard) for (old shard, block, bytes).

    An old shard's blocks are laid end to end and its flows cut from them, the
    one that stays first.
    """
    flows: dict[int, list] = defaultdict(list)
    for (i, j), n in sorted(transfers.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        flows[i].append([j, n])
    out = []
    for i, block, size in sorted(blocks):
        at = 0
        while at < size:
            target = flows[i][0]
            part = min(size - at, target[1])
            out.append((i, block, at, at + part, target[0]))
            at += part
            target[1] -= part
            if not target[1] and len(flows[i]) > 1:
                flows[i].pop(0)
    return out


@dataclass
class Transfers:
    """What a flow of least cost comes to: block transfers, and the shards that gain or lose bytes."""

    blocks: int
    whole: DataFrame
    divided: DataFrame
    affected: list[int]


def _addressed(df: DataFrame, old_shard: Column, text_col: str, blocks: int) -> DataFrame:
    """Rows with size, crc, old shard, number and block; names are free to clash, as they are nested."""
    text = F.col(text_col).cast("string")
    own = F.struct(
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(old_shard.cast("int"), F.lit(-1)).alias("old_shard"),
        F.monotonically_increasing_id().alias("row_no"),
    )
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), own.alias("own")).select("row", "own.*")
    return rows.withColumn("block", F.pmod(F.xxhash64("row_no"), F.lit(blocks)).cast("int"))


def _solve(rows: DataFrame, new_shards: int | dict[int, int], blocks: int) -> Transfers:
    """Transfers for ``rows`` (old_shard, block, row_no, size)."""
    spark = rows.sparkSession
    # One row per old shard and block: a number that the shard counts and ``MOST_BLOCKS`` bound.
    sums = [tuple(r) for r in rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes")).collect()]
    supply: dict[int, int] = defaultdict(int)
    for i, _, n in sums:
        supply[i] += n
    if isinstance(new_shards, int):
        new_shards = dict(enumerate(near_equal(sum(supply.values()), new_shards)))
    flow = min_cost_transfers(supply, new_shards)
    plan = divide_blocks(sums, flow)
    parts = Counter((i, block) for i, block, *_ in plan)
    whole = spark.createDataFrame([(i, b, j) for i, b, _, _, j in plan if parts[i, b] == 1], "old_shard int, block int, shard int")
    cut = spark.createDataFrame([p for p in plan if parts[p[0], p[1]] > 1], "old_shard int, block int, from_byte long, to_byte long, shard int")
    before = Window.partitionBy("old_shard", "block").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.join(F.broadcast(cut.select("old_shard", "block").distinct()), ["old_shard", "block"], "left_semi")
    inside = inside.withColumn("middle", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.expr("size div 2"))
    divided = inside.join(F.broadcast(cut), ["old_shard", "block"]).where("middle >= from_byte and middle < to_byte").select("row_no", "shard")
    return Transfers(blocks, whole, materialize(divided, "divided-blocks"), sorted({k for i, j in flow if i != j for k in (i, j)}))


def _placed(rows: DataFrame, moves: Transfers) -> DataFrame:
    """``rows`` with their shard: a whole block's, or in a block that a flow divides, the row's own."""
    of_block = moves.whole.withColumnRenamed("shard", "of_block")
    of_row = moves.divided.withColumnRenamed("shard", "of_row")  # few rows; how they are joined is left to their size
    joined = rows.join(F.broadcast(of_block), ["old_shard", "block"], "left").join(of_row, "row_no", "left")
    return joined.withColumn("shard", F.coalesce("of_block", "of_row")).drop("of_block", "of_row")


def _parts(total: int, shards: int) -> int:
    """Files of a shard, of some hundred MB."""
    return max(1, -(-total // max(1, shards) // FILE_BYTES))


def _slotted(placed: DataFrame, narrow: DataFrame, parts: int) -> DataFrame:
    """``placed`` with slots: rows of a part of a shard in order, the parts one after the other.

    ``narrow`` are the same rows without payload, for counting.
    """
    part = F.pmod("block", F.lit(parts)).alias("part")
    counts = narrow.groupBy("shard", part).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    here = F.row_number().over(Window.partitionBy("shard", "part").orderBy("old_shard", "block", "row_no")) - 1
    return placed.withColumn("part", part).withColumn("slot", here).join(begins, ["shard", "part"]).withColumn("slot", F.col("begin") + F.col("slot")).drop("begin")


def _prepared(df: DataFrame, old_shard: Column, new_shards: int | dict[int, int], text_col: str, blocks: int) -> tuple[DataFrame, DataFrame, Transfers, int]:
    """Addressed rows, the same without payload and with shards, the transfers, and the parts of a shard."""
    total = df.agg(F.sum(F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) + OVERHEAD)).first()[0] or 0
    blocks = max(blocks, min(MOST_BLOCKS, -(-total // BLOCK_BYTES)))
    rows = _addressed(df, old_shard, text_col, blocks)
    sizes = materialize(rows.select("old_shard", "block", "row_no", "size"), "sizes")
    moves = _solve(sizes, new_shards, blocks)
    return rows, materialize(_placed(sizes, moves), "placed"), moves, _parts(total, new_shards if isinstance(new_shards, int) else len(new_shards))


def reshard(df: DataFrame, old_shard: Column, new_shards: int | dict[int, int], id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS) -> DataFrame:
    """Assign every row a new shard and a slot in it, moving the fewest bytes; no file is written.

    ``new_shards``: how many (near equal in bytes), or capacities in bytes by
    shard.  Returns doc_id, size, text_crc32, law, old_shard, shard, slot,
    grown_shard (null under this law).
    """
    rows, narrow, moves, parts = _prepared(df, old_shard, new_shards, text_col, blocks)
    slim = rows.select(F.col(f"row.`{id_col}`").alias("doc_id"), "size", "text_crc32", "old_shard", "block", "row_no")
    return _slotted(_placed(slim, moves), narrow, parts).select("doc_id", "size", "text_crc32", *map(F.expr, _LAW), "old_shard", "shard", "slot")


_LAW = ["'bytes' AS law", "CAST(NULL AS int) AS grown_shard"]


def rewrite_affected(df: DataFrame, old_shard: Column, new_shards: int | dict[int, int], path: str, id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS) -> tuple[DataFrame, list[int]]:
    """Write the shards that gain or lose rows anew under ``path``/shard=N, whole rows in order of slots.

    Returns the placement of all rows (as ``reshard``), that of written rows as
    read back from the files, and the shards affected.  Shards not affected keep
    their old files; an affected one without a folder under ``path`` has become
    empty.  ``path`` is a new folder, so the old layout is whole until a reader
    is pointed to the new one.  Rows are placed by their number in the scan, not by
    id: repeated and null ids are written as often as they occur.  ``df`` must give
    the same rows in the same partitions when it is read twice, as stored
    tables do; written shards are counted against the plan, and a difference stops the job.
    """
    rows, narrow, moves, parts = _prepared(df, old_shard, new_shards, text_col, blocks)
    placed = _slotted(_placed(rows, moves), narrow, parts)
    of_affected = F.col("shard").isin(moves.affected)
    out = placed.where(of_affected).select("row", "old_shard", "slot", "shard")
    out.write.partitionBy("shard").parquet(path)
    written = df.sparkSession.read.schema(out.schema).parquet(path)
    _same_rows(narrow.where(of_affected), written)
    text = F.col(f"row.`{text_col}`").cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size")
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32")
    seen = written.select(F.col(f"row.`{id_col}`").alias("doc_id"), size, crc, *map(F.expr, _LAW), "old_shard", "shard", "slot")
    kept = reshard_rest(rows, moves, narrow, parts, id_col)
    return seen.union(kept), moves.affected


def _same_rows(planned: DataFrame, written: DataFrame) -> None:
    """Stop where a shard has other numbers of rows, or slots, than planned; texts are not read."""
    plan = planned.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    there = written.groupBy("shard").agg(F.count(F.lit(1)).alias("there"), F.max("slot").alias("last"))
    both = plan.join(there, "shard", "full")
    odd = both.where("rows is null or there is null or rows <> there or last <> rows - 1").select("shard").take(5)
    if odd:
        raise RuntimeError(f"rows moved between readings of the table: written shards {sorted(r.shard for r in odd)} are not as planned")


def reshard_rest(rows: DataFrame, moves: Transfers, narrow: DataFrame, parts: int, id_col: str) -> DataFrame:
    """The placement of the rows of shards that are not affected."""
    slim = rows.select(F.col(f"row.`{id_col}`").alias("doc_id"), "size", "text_crc32", "old_shard", "block", "row_no")
    slim = slim.where(~F.col("old_shard").isin(moves.affected))
    return _slotted(_placed(slim, moves), narrow, parts).select("doc_id", "size", "text_crc32", *map(F.expr, _LAW), "old_shard", "shard", "slot")


def affected_shards(placed: DataFrame) -> DataFrame:
    """The shards that gain or lose rows, with the bytes that come and go."""
    moved = placed.where(F.col("old_shard") != F.col("shard"))
    gains = moved.groupBy("shard").agg(F.sum("size").alias("gained"))
    loses = moved.groupBy(F.col("old_shard").alias("shard")).agg(F.sum("size").alias("lost"))
    return gains.join(loses, "shard", "full").select("shard", F.coalesce("gained", F.lit(0)).alias("gained"), F.coalesce("lost", F.lit(0)).alias("lost"))
