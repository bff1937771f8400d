"""Near-duplicate embeddings by lattice hashing: random projections, decoded to points of E8.

A random rotation parts a unit vector of any width into blocks of eight
coordinates, a table each.  In each table a vector lies in the cell of the lattice
point nearest to its block, and probes the neighbouring cells that a linked vector
could lie in.  That finds every link: if two unit vectors are no more than D
apart, then in one of T tables they are no more than D / sqrt(T) apart, and a
probe reaches every cell that such a step can reach (``probes``).  So recall is 1 up to
rounding, and tests and brute force agree; what is found is verified by its cosine.

Work goes in two passes over the same cells.  The first moves eight coordinates
a row and keeps those that have a partner near enough in the table; few vectors without
a near copy are left.  The second brings the vectors of what is left and takes cosines,
block by block.  A pair that meets in several tables counts in the first table in
which it is near enough.  No pairs are written: a block gives the number of links of
each of its vectors, and links enough to connect them.

Copies of one vector are one vector with a weight.  Cells of more than BLOCK
vectors are parted, and their parts meet in pairs, so no task gets a whole one; the
work of comparing stays quadratic in a crowd of near copies that are not equal, as all their links count.

Defined results: vectors that are null, zero, empty, or hold null or non-finite
components, and rows with a null label, have no links and are components of their own; vectors
of different lengths are never compared; rows with equal vectors are linked with each other and with the
same others, repeated rows too; a null id is never smallest, and a component of null ids alone has a null
component_id; ties do not arise; empty tables give no rows; other columns may have any name.
"""

from __future__ import annotations

import itertools
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graphs import connected_components
from .vectors import by_length, usable

#: Vectors of a part of a cell; two parts meet in a task at a time.
BLOCK = 512
#: Covering radius of a table's lattice over the distance that a table must find; larger cells need fewer probes and compare more.
CELL = 3.5
#: Rows that are projected together.
ROWS = 1024
SLACK = 1e-6


@lru_cache(maxsize=None)
def near_points() -> tuple[np.ndarray, np.ndarray]:
    """The 2,400 points of E8 of norm 2 and 4, and their lengths.

    Points of norm 2 are by rule: two entries of 1 or -1, or all entries one half with
    an even number of minus signs; those of norm 4 are sums of two of them.
    """
    found = []
    for pair in itertools.combinations(range(8), 2):
        for signs in itertools.product((1.0, -1.0), repeat=2):
            point = np.zeros(8)
            point[list(pair)] = signs
            found.append(point)
    found += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    first = np.array(found)
    sums = (first[:, None] + first[None]).reshape(-1, 8)
    second = np.unique(sums[np.abs((sums**2).sum(axis=1) - 4) < 1e-9], axis=0)
    points = np.concatenate([first, second])
    return points, np.sqrt((points**2).sum(axis=1))


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole entries of an even sum."""
    near = np.rint(x)
    rest = x - near
    at, rows = np.abs(rest).argmax(axis=1), np.arange(len(x))
    odd = near.sum(axis=1) % 2 != 0
    near[rows, at] += np.where(odd, np.where(rest[rows, at] >= 0, 1.0, -1.0), 0.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of the even points and their shift by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


def probes(x: np.ndarray, cells: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, point): the neighbouring points in whose cells something within ``reach`` of a row may lie.

    A step of length r changes the difference of the squared distances to two points by
    at most 2 r times their distance.  For a reach of up to 0.4, points of norm 6 and more
    cannot fulfil this: such a point is a sum of two of norm 2, with either of which
    a position in the cell has a product of at most 1.
    """
    if reach > 0.4:
        raise ValueError("cells are too small for their reach")
    points, lengths = near_points()
    away = lengths**2 - 2 * (x - cells) @ points.T
    row, which = np.nonzero(away <= 2 * reach * lengths * (1 + SLACK) + SLACK)
    return row, cells[row] + points[which]


@lru_cache(maxsize=None)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix; dimensions are filled up with zeros to a multiple of eight."""
    size = -(-dim // 8) * 8
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(size, size)))
    return (q * np.sign(np.diag(r)))[:dim]


def scaled(matrix: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish; cosines stay the same to the last bit."""
    return np.ldexp(matrix, -np.frexp(np.abs(matrix).max(axis=1))[1][:, None])


class Tables:
    """Tables for a cosine: distances of unit vectors and scales of the lattice."""

    def __init__(self, cosine: float, seed: int = 11, cell: float = CELL):
        self.cosine, self.seed, self.cell = cosine, seed, cell
        self.apart = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9

    def near(self, dim: int) -> float:
        """The distance within which a linked pair lies in one table at least."""
        return self.apart / math.sqrt(-(-dim // 8)) * (1 + SLACK)

    def project(self, matrix: np.ndarray) -> np.ndarray:
        """(rows, tables, 8): rotated unit vectors; each row's values do not depend on the others."""
        unit = scaled(matrix)
        unit = unit / np.sqrt((unit**2).sum(axis=1))[:, None]
        return np.einsum("nd,de->ne", unit, rotation(matrix.shape[1], self.seed)).reshape(len(matrix), -1, 8)


def _keys(cells: np.ndarray) -> np.ndarray:
    """64 bits of a lattice point, whose doubled entries are whole."""
    key = np.zeros(len(cells), dtype=np.uint64)
    for column in np.rint(cells * 2).astype(np.int64).T:
        key = (key ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.astype(np.int64)


def _smaller(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether points come before others, entry by entry."""
    apart = np.rint((a - b) * 2)
    first = (apart != 0).argmax(axis=1)
    return apart[np.arange(len(a)), first] < 0


PLACED = "node long, label string, dim int, t int, cell long, own boolean, part binary"


def placed(nodes: DataFrame, tables: Tables) -> DataFrame:
    """Rows of every vector in its own cell of each table, and in those that it probes.

    Of two neighbouring cells the vectors of the later one probe the earlier one,
    so that two vectors meet once in a table.
    """

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                ids, labels = (batch.column(i).slice(begin, ROWS) for i in (0, 1))
                for at, matrix in by_length(batch.column(2).slice(begin, ROWS)):
                    dim = matrix.shape[1]
                    blocks, scale = tables.project(matrix), tables.near(dim) * tables.cell
                    for t in range(blocks.shape[1]):
                        x = blocks[:, t] / scale
                        cells = decode(x)
                        row, points = probes(x, cells, 1 / tables.cell)
                        ahead = _smaller(points, cells[row])
                        row, points = row[ahead], points[ahead]
                        rows = np.concatenate([np.arange(len(at)), row])
                        own = np.concatenate([np.ones(len(at), bool), np.zeros(len(row), bool)])
                        part = np.ascontiguousarray(blocks[rows, t].astype(np.float32)).tobytes()
                        take = pa.array(at[rows])
                        yield pa.RecordBatch.from_arrays(
                            [
                                ids.take(take),
                                labels.take(take),
                                pa.array(np.full(len(rows), dim, np.int32)),
                                pa.array(np.full(len(rows), t, np.int32)),
                                pa.array(_keys(np.concatenate([cells, points]))),
                                pa.array(own),
                                pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(rows), [None, pa.py_buffer(part)]).cast(pa.binary()),
                            ],
                            ["node", "label", "dim", "t", "cell", "own", "part"],
                        )

    return nodes.select("node", "label", "v").mapInArrow(run, PLACED)


CELL_KEY = ["label", "dim", "t", "cell"]


def in_parts(rows: DataFrame) -> DataFrame:
    """Rows with the pair of parts, ``meet``, of their cell in which they are compared.

    A cell of more than BLOCK vectors is parted; every two parts of its own
    vectors meet, and every part of them meets every part of those that probe it.
    """
    counts = rows.groupBy(*CELL_KEY).agg(F.count_if("own").alias("n"), F.count_if(~F.col("own")).alias("m"))
    crowded = counts.where(F.col("n") + F.col("m") > BLOCK).select(*CELL_KEY, F.ceil(F.col("n") / BLOCK).cast("int").alias("a"), F.ceil(F.col("m") / BLOCK).cast("int").alias("b"))
    joined = rows.join(crowded, CELL_KEY, "left")
    h = F.xxhash64("node", F.lit(5))
    mine, theirs = F.pmod(h, F.greatest("a", F.lit(1))).cast("int"), F.pmod(h, F.greatest("b", F.lit(1))).cast("int")
    to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    among = F.transform(to(F.col("a")), lambda k: F.struct(F.least(mine, k).alias("i"), F.greatest(mine, k).alias("j"), F.lit(False).alias("probed")))
    asked = F.transform(to(F.col("b")), lambda k: F.struct(mine.alias("i"), k.alias("j"), F.lit(True).alias("probed")))
    asks = F.transform(to(F.col("a")), lambda k: F.struct(k.alias("i"), theirs.alias("j"), F.lit(True).alias("probed")))
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(None).cast("boolean").alias("probed")))
    meets = F.when(F.col("a").isNull(), whole).when(F.col("own"), F.concat(among, asked)).otherwise(asks)
    return joined.withColumns({"home": mine, "meet": meets}).drop("a", "b").withColumn("meet", F.explode("meet"))


def gathered(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of a cell's parts side by side."""
    key = F.struct(*CELL_KEY, "meet.i", "meet.j", "meet.probed")
    hashed = rows.select(F.xxhash64(key).alias("h"), *CELL_KEY, F.col("meet.i").alias("i"), F.col("meet.j").alias("j"), "meet.probed", "node", "own", "home", *columns)
    return hashed.repartition("h").sortWithinPartitions("h", *CELL_KEY, "i", "j", "probed", F.desc("own"), "home", "node")


def _runs(batches):
    """Tables of the rows that are compared with each other, from sorted batches."""
    names = ["label", "dim", "t", "cell", "i", "j", "probed"]

    def borders(table: pa.Table) -> np.ndarray:
        changed = np.zeros(table.num_rows, bool)
        changed[0] = True
        for n in names:
            column = table.column(n).combine_chunks()
            if n == "label":
                column = column.dictionary_encode().indices
            if n == "probed":
                column = column.cast(pa.int8()).fill_null(2)
            v = column.to_numpy(zero_copy_only=False)
            changed[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(changed)

    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        if not table.num_rows:
            continue
        at = borders(table)
        yield table.slice(0, at[-1]), at
        rest = table.slice(at[-1])
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def _compared(own: np.ndarray, home: np.ndarray, i: int, j: int, probed) -> tuple[np.ndarray, np.ndarray, bool, np.ndarray, np.ndarray]:
    """Rows on either side, whether the left side is compared with itself, and the sides' rows.

    In a whole cell its own vectors meet each other and those that probe it; in
    a pair of parts either only.
    """
    mine, others = np.flatnonzero(own), np.flatnonzero(~own)
    if probed is None:
        return mine, others, True
    if probed:
        return mine, others, False
    return (mine, others, True) if i == j else (mine[home[mine] == i], mine[home[mine] == j], False)


def _near_enough(batches, near_of):
    """Rows of cells that have a partner within the distance of their table."""
    for table, at in _runs(batches):
        if not table.num_rows:
            continue
        own, home, i, j, dim = (table.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in ("own", "home", "i", "j", "dim"))
        probed = table.column("probed").to_pylist()
        part = np.frombuffer(b"".join(table.column("part").to_pylist()), np.float32).reshape(-1, 8).astype(np.float64)
        keep = np.zeros(table.num_rows, bool)
        for a, b in itertools.pairwise(at):
            if b - a < 2 or b > table.num_rows:
                continue
            left, right, itself = _compared(own[a:b], home[a:b], i[a], j[a], probed[a])
            if not len(left):
                continue
            x, limit = part[a:b], near_of(int(dim[a])) ** 2 * (1 + 1e-4) + 1e-9
            length = (x**2).sum(axis=1)
            apart = lambda p, q: length[p][:, None] + length[q] - 2 * x[p] @ x[q].T
            if itself and len(left) > 1:
                near = apart(left, left) <= limit
                np.fill_diagonal(near, False)
                keep[a + left] |= near.any(axis=1)
            if len(right):
                near = apart(left, right) <= limit
                keep[a + left] |= near.any(axis=1)
                keep[a + right] |= near.any(axis=0)
        if keep.any():
            yield from table.select(["node", "label", "dim", "t", "cell", "own"]).filter(pa.array(keep)).to_batches()


def _links(batches, tables: Tables):
    """(node, links, other): verified links by vector, each vector with one that is connected to it."""
    for table, at in _runs(batches):
        if not table.num_rows:
            continue
        own, home, i, j, node, weight, t = (table.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in ("own", "home", "i", "j", "node", "weight", "t"))
        probed, vectors = table.column("probed").to_pylist(), table.column("v").combine_chunks()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in itertools.pairwise(at):
            if b - a < 2 or b > table.num_rows:
                continue
            left, right, itself = _compared(own[a:b], home[a:b], i[a], j[a], probed[a])
            if not len(left):
                continue
            ((_, matrix),) = by_length(vectors.slice(a, b - a))
            matrix = scaled(matrix)
            length = np.sqrt((matrix**2).sum(axis=1))
            blocks, near = tables.project(matrix), tables.near(matrix.shape[1])
            degree, label = np.zeros(b - a, np.int64), np.arange(b - a)
            sides = ([(left, left)] if itself else []) + ([(left, right)] if len(right) else [])
            for p, q in sides:
                cosine = matrix[p] @ matrix[q].T / length[p][:, None] / length[q]
                r, c = np.nonzero(cosine >= tables.cosine)
                if p is q:
                    r, c = r[r < c], c[r < c]
                for begin in range(0, len(r), 65536):
                    x, y = p[r[begin : begin + 65536]], q[c[begin : begin + 65536]]
                    first = (((blocks[x] - blocks[y]) ** 2).sum(axis=2) <= near**2).argmax(axis=1)
                    x, y = x[first == t[a]], y[first == t[a]]
                    np.add.at(degree, x, weight[a + y])
                    np.add.at(degree, y, weight[a + x])
                    before = None
                    while len(x) and (before is None or (before != label).any()):
                        before = label.copy()
                        least = np.minimum(label[x], label[y])
                        np.minimum.at(label, x, least)
                        np.minimum.at(label, y, least)
            hit = np.flatnonzero(degree)
            if len(hit):
                out.append((node[a + hit], degree[hit], node[a + label[hit]]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["node", "links", "other"])


def near_duplicates(df: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", label_col: str = "label", vector: str = "embedding", seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row; only vectors with equal labels are linked."""
    tables = Tables(cosine, seed)
    length = F.exists(F.col(vector), lambda x: x != 0)
    fits = F.col(label_col).isNotNull() & usable(vector) & F.coalesce(length, F.lit(False))
    rows = df.select(F.col(id_col).alias("vec_id"), F.when(fits, F.col(label_col).cast("string")).alias("label"), F.when(fits, F.col(vector)).alias("v"))
    distinct = rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
    nodes = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")

    near_of = tables.near
    light = in_parts(materialize(placed(nodes, tables), "cells"))
    left = gathered(light, "part").mapInArrow(lambda b: _near_enough(b, near_of), "node long, label string, dim int, t int, cell long, own boolean").distinct()
    left = materialize(left, "near-cells")
    heavy = in_parts(left.join(nodes.select("node", "v", "weight"), "node"))
    found = materialize(gathered(heavy, "v", "weight").mapInArrow(lambda b: _links(b, tables), "node long, links long, other long"), "vector-links")

    degrees = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b"))).withColumnRenamed("label", "root")
    rooted = nodes.select("node", "label", "v", "least", "weight").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")).join(degrees, "node", "left")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_vector = rooted.join(smallest, "root").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    linked = rows.where("v is not null").join(of_vector, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
