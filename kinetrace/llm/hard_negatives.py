"""Hard negatives by dense products of anchor blocks with candidate blocks.

Anchors go out in groups of a fixed size, a broadcast each; every task multiplies
them with its candidates block by block and keeps the best of what it has seen,
so a task's memory is bounded and what leaves it is a few rows an anchor.  The first
pass finds the positives of each anchor, whose partial lists are merged by taking the
best again; the second pass finds, for each positive, the best negatives in the
window of scores that it allows.  Components are integers, so products in double
precision are exact as long as sums stay below 2^53, which is checked.

Defined results: rows with a null id, a null label, or a vector that is null, empty, or has
null or non-finite components take no part; vectors of different lengths are never compared;
equal scores are ordered by id; rows with an anchor's own id are not its positives; repeated rows
are candidates each, and repeated anchors have rows each; an anchor without positives, and a positive
without negatives, gives no row; empty tables give none; other columns may have any name.  Components so
large that a product may exceed 2^53 stop the job with a message.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch_path
from .vectors import by_length, usable

#: Anchors that go out together: their vectors and lists bound a task's memory, whatever the table's size.
ANCHORS = 8192
#: Anchors and candidates that are multiplied at once.
BLOCK = 1024
#: Window of a negative's score, in hundredths of it and parts of the positive's.
LOW, SCALE, HIGH = 30, 100, 90
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def quantized(vector: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * vector)


class Best:
    """The best ``k`` (score, id) of each slot, from blocks of scores."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.scores = np.full((slots, k), -np.inf)
        self.ids = np.full((slots, k), np.iinfo(np.int64).max)

    def offer(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` has a row for each of ``slots`` and a column for each of ``ids``; -inf: not allowed."""
        k = self.k
        least = self.scores[slots, -1]
        if scores.shape[1] > k and np.isneginf(least).any():
            least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
        r, c = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        if not len(r):
            return
        touched, r = np.unique(r, return_inverse=True)
        old = slots[touched]
        slot = np.concatenate([r, np.repeat(np.arange(len(touched)), k)])
        value = np.concatenate([scores[touched[r], c], self.scores[old].ravel()])
        name = np.concatenate([ids[c], self.ids[old].ravel()])
        order = np.lexsort((name, -value, slot))
        slot, value, name = slot[order], value[order], name[order]
        first = np.searchsorted(slot, np.arange(len(touched)))
        place = np.arange(len(slot)) - first[slot]
        keep = place < k
        self.scores[old[slot[keep]], place[keep]] = value[keep]
        self.ids[old[slot[keep]], place[keep]] = name[keep]


def candidate_blocks(batches):
    """(ids, labels, integer vectors) of one length and at most BLOCK rows."""
    for batch in batches:
        for begin in range(0, batch.num_rows, BLOCK):
            part = batch.slice(begin, BLOCK)
            ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
            for at, m in by_length(part.column(2)):
                yield ids[at], labels[at], quantized(m)


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2.0**53:
        raise ValueError("components are too large for exact products in double precision")
    return a @ b.T


class AnchorGroup:
    """Anchors that travel together: ids, labels and integer vectors by length."""

    def __init__(self, table: pa.Table):
        self.ids, self.labels, self.rows = (table.column(n).to_numpy() for n in ("id", "label", "anchor"))
        vectors = pa.concat_arrays(table.column("v").chunks) if table.num_rows else pa.array([], table.schema.field("v").type)
        self.matrices = [(at, quantized(m)) for at, m in by_length(vectors)]

    def scores(self, x: np.ndarray, labels: np.ndarray):
        """(places of anchors, their products with ``x``), BLOCK anchors at a time."""
        for at, m in self.matrices:
            if m.shape[1] == x.shape[1]:
                for begin in range(0, len(at), BLOCK):
                    yield at[begin : begin + BLOCK], exact_product(m[begin : begin + BLOCK], x)


def _lists(best: Best, keys: dict[str, np.ndarray], slots: np.ndarray):
    """Rows of what each slot holds."""
    s, p = np.nonzero(best.scores[slots] > -np.inf)
    at = slots[s]
    cells = [pa.array(v[at]) for v in keys.values()]
    return pa.RecordBatch.from_arrays([*cells, pa.array(best.scores[at, p].astype(np.int64)), pa.array(best.ids[at, p])], [*keys, "score", "id"])


def first_of(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """The best ``k`` of merged lists; each task's share is cut to ``k`` before it moves."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("id"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _positives(rows: DataFrame, group: AnchorGroup, k: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(group)

    def run(batches):
        g = shared.value
        best = Best(len(g.ids), k)
        for ids, labels, x in candidate_blocks(batches):
            for at, products in g.scores(x, labels):
                allowed = (g.labels[at][:, None] == labels) & (g.ids[at][:, None] != ids)
                best.offer(at, np.where(allowed, products, -np.inf), ids)
        yield _lists(best, {"anchor": g.rows}, np.arange(len(g.ids)))

    return first_of(rows.select("id", "label", "v").mapInArrow(run, "anchor long, score long, id long"), ["anchor"], k)


def _negatives(rows: DataFrame, group: AnchorGroup, positives: pa.Table, k: int) -> DataFrame:
    """``positives``: (anchor, rank, score, id); a slot is an anchor's positive."""
    where = {int(a): n for n, a in enumerate(group.rows)}
    slots = sorted(zip((where[a] for a in positives.column("anchor").to_pylist()), *(positives.column(c).to_pylist() for c in ("rank", "score", "id")), strict=True))
    place, rank, score, name = (np.array([s[i] for s in slots], dtype=np.int64) for i in range(4))
    shared = rows.sparkSession.sparkContext.broadcast((group, place, rank, score, name))

    def run(batches):
        g, place, rank, score, name = shared.value
        best = Best(len(place), k)
        begin = np.searchsorted(place, np.arange(len(g.ids) + 1))
        for ids, labels, x in candidate_blocks(batches):
            for at, products in g.scores(x, labels):
                products = np.where(g.labels[at][:, None] != labels, products, -np.inf)
                for nth in range(int(np.diff(begin).max(initial=0))):
                    has = begin[at] + nth < begin[at + 1]
                    slot = begin[at[has]] + nth
                    n, p = SCALE * products[has], score[slot][:, None]
                    best.offer(slot, np.where((n >= LOW * p) & (n <= HIGH * p), products[has], -np.inf), ids)
        yield _lists(best, {"anchor": g.rows[place], "nth": rank, "positive_score": score, "positive_id": name}, np.arange(len(place)))

    found = rows.select("id", "label", "v").mapInArrow(run, "anchor long, nth long, positive_score long, positive_id long, score long, id long")
    return first_of(found, ["anchor", "nth", "positive_score", "positive_id"], k)


def mine(df: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector: str = "embedding", positives: int = 5, negatives: int = 10, anchors: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor.

    ``is_anchor`` and ``label`` are expressions over the table's columns.
    """
    rows = df.where(F.col(id_col).isNotNull() & label.isNotNull() & usable(vector)).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    # Numbered once and written: all passes see the same anchors in the same groups.
    numbered = materialize(rows.where("asks").select("id", "label", "v", F.monotonically_increasing_id().alias("row")), "anchors")
    path, groups = scratch_path(df.sparkSession, "negatives"), -(-numbered.count() // anchors)
    for number in range(groups):
        # Groups by hash are of nearly equal size.
        own = numbered.where(F.pmod(F.xxhash64("row"), F.lit(groups)) == number)
        group = AnchorGroup(own.select("id", "label", "v", F.col("row").alias("anchor")).toArrow())
        if not len(group.ids):
            continue
        best = _positives(rows, group, positives).select("anchor", F.col("rank").cast("long").alias("rank"), "score", "id").toArrow()
        names = own.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
        found = _negatives(rows, group, best, negatives).join(names, "anchor")
        found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    if not groups:
        return df.sparkSession.createDataFrame([], RESULT)
    return df.sparkSession.read.schema(RESULT).parquet(path)
