"""Near-duplicate detection: MinHash with an LSH forest.

A document is its set of word shingles.  Sets that are equal are one node.  Each
node's signature of ``HASHES`` minima is read in ``ORDERS`` different orders;
every order is range-sorted as a whole, so nodes that share long prefixes of
signature stand side by side.  A node's candidates in an order are the
``NEIGHBOURS`` that follow it and share a prefix of at least ``LEAST_DEPTH``
minima: sparse regions are searched at that depth, and the denser a region is,
the longer the prefix that its neighbours share.  Sorting is by signature and
node, so a region of any size spreads over tasks and no group is ever gathered.

Candidates are kept if their lengths and signatures allow the similarity, and
are confirmed on the full sets of both texts: first two candidates of each node
and two hubs of its crowded regions, whose links give components, then all others
whose ends are still apart.

A region that holds more nodes than a neighbourhood reaches is crowded.  How deep
it is searched follows from how many nodes it holds: its prefix is lengthened, part
by part, until a part is no longer crowded, so that all its pairs are candidates.
Unrelated texts part quickly; parts that are still crowded at ``FINISH_DEPTH`` minima
hold copies or texts that share a form.  There a node is compared with the hubs of
the shallowest and of the deepest crowded part, and parts that then still hold more than
one component are finished exactly: every pair of their nodes in different
components that can be linked is found by a prefix filter on the sets' rarest
shingles and confirmed on full sets.  A region of any size is spread over ``SALTS``
keys, whose counts, hubs and labels are added up.

What can be missed: a link of similarity 0.8 shares the first two minima in an
order with chance 0.64, so it is in none of 16 with chance 8e-8; where regions are
crowded at all depths below, it has to share four, and is missed with chance 2e-4 (1e-7 at
similarity 0.9). Its signatures agree in fewer than 30 of 64 places with chance 1e-9.

Defined results: a text of fewer words than a shingle is one shingle; a null
text, or one without words, has no shingle and is linked with nothing; equal
texts, and texts with equal sets, are linked; the component's id is its smallest
document id, a null id being no candidate; rows repeated with the same id share
its verdict; a text of any length is read whole; other columns may have any name,
as only id and text are taken into the work; an empty table gives no rows.
Shingles are told apart by 64-bit hashes, sets by 128-bit ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, id_place, materialize, slices, text_or_empty
from .graphs import connected_components

HASHES, ORDERS, LEVELS, LEAST_DEPTH, FINISH_DEPTH, NEIGHBOURS = 64, 16, 6, 2, 4, 4
#: Places of 64 in which signatures agree at least (with 8 bits a place).
LEAST_AGREEMENT = 30
#: Agreement that makes a link likely; only an order of work depends on it.
LIKELY_AGREEMENT = 48
#: Counters of shingles in crowded regions, as powers of two: one a shingle, within these bounds; how many are added up together.
LEAST_COUNTERS, MOST_COUNTERS, COUNTERS_A_PART = 16, 24, 12
SALTS = 64
#: Words whose hash a worker keeps; it keeps them for its whole life, beside what later stages load.
CACHE = 100_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = _WordHashes()
_ODD = np.random.default_rng(5).integers(1 << 62, size=(2, HASHES), dtype=np.uint64) | np.uint64(1)
_ORDERS = np.array([np.random.default_rng(100 + t).permutation(HASHES)[:LEVELS] for t in range(ORDERS)])


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingles of the lower-case words (A-Z, ASCII white space)."""
    words = text.encode().lower().split()
    if not words:
        return np.array([], dtype=np.uint64)
    codes = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(codes))
    mixed = codes[: len(codes) - width + 1] + np.uint64(width)
    for i in range(1, width):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + codes[i : len(codes) - width + 1 + i]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, HASHES) signature of non-empty sets."""
    flat = np.concatenate(sets)
    begins = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), HASHES), dtype=np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat((flat * _ODD[0, k] + _ODD[1, k]) >> np.uint64(32), begins)
    return out


def signatures(df: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, n_shingles, digest, minima) of each row; digest and minima are null without words."""
    def run(batches):
        for batch in slices(batches):
            sets = [shingles(t, width) for t in batch.column(2).to_pylist()]
            full = [s for s in sets if len(s)]
            rows = iter(minima(full)) if full else iter(())
            signs = [next(rows).tobytes() if len(s) else None for s in sets]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "digest", "minima"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    text = text_or_empty(text_col)
    return df.select(F.col(id_col), F.xxhash64(text), text).mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, digest binary, minima binary")


def forest_rows(nodes: DataFrame) -> DataFrame:
    """A row for each node and order: its place in the order, and its signature in short."""

    def run(batches):
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            full = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint32).reshape(-1, HASHES)
            short = [row.tobytes() for row in full.astype(np.uint8)]
            levels = (full & 0xFFFF).astype(np.uint64)
            for t in range(ORDERS):
                path = levels[:, _ORDERS[t]]
                key = (path[:, 0] << np.uint64(48)) | (path[:, 1] << np.uint64(32)) | (path[:, 2] << np.uint64(16)) | path[:, 3]
                deeper = (path[:, 4] << np.uint64(15)) | (path[:, 5] >> np.uint64(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(full), t, np.int8)), pa.array(key.view(np.int64)), pa.array(deeper.astype(np.int32)), batch.column(0), batch.column(1).cast(pa.int32()), pa.array(short, pa.binary())],
                    ["order", "key", "deeper", "node", "n", "short"],
                )

    return nodes.select("node", "n_shingles", "minima").mapInArrow(run, "order byte, key long, deeper int, node long, n int, short binary")


def _tables(batches, size=30_000):
    held, n = [], 0
    for batch in slices(batches):
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


_PAIRS = "a long, b long, agree int"
_SORTED = ["order", "key", "deeper", "node", "n", "short"]


def _following(threshold: float, with_ends: bool):
    """A pass over sorted rows that yields candidates and, if asked, the range's first and last rows."""

    def run(batches):
        tail, head, total = None, None, 0
        for table in _tables(batches):
            table = table.select(_SORTED)
            total += len(table)
            if head is None:
                head = table.slice(0, 2 * NEIGHBOURS)
            if tail is not None:
                table = pa.concat_tables([tail, table])
            fresh = len(tail) if tail is not None else 0
            tail = table.slice(max(0, len(table) - NEIGHBOURS))
            order, key, node, n = (table.column(c).to_numpy() for c in ("order", "key", "node", "n"))
            depth = key.view(np.uint64) >> np.uint64(64 - 16 * LEAST_DEPTH)
            short = np.frombuffer(b"".join(table.column("short").to_pylist()), dtype=np.uint8).reshape(-1, HASHES)
            found = []
            for j in range(1, min(NEIGHBOURS, len(table) - 1) + 1):
                first = np.arange(max(0, fresh - j), len(table) - j)  # pairs whose second row is new
                second = first + j
                same = (order[first] == order[second]) & (depth[first] == depth[second])
                same &= np.minimum(n[first], n[second]) >= threshold * np.maximum(n[first], n[second]) - 1e-9
                first, second = first[same], second[same]
                agree = (short[first] == short[second]).sum(axis=1)
                good = agree >= LEAST_AGREEMENT
                found.append((node[first[good]], node[second[good]], agree[good]))
            a, b, agree = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.array([], np.int64),) * 3
            pairs = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(agree.astype(np.int32))]
            rest = [pa.nulls(len(a), f.type) for f in table.schema] if with_ends else []
            yield pa.RecordBatch.from_arrays(pairs + rest, ["a", "b", "agree"] + _SORTED * with_ends)
        if with_ends and total:
            ends = head if total <= 2 * NEIGHBOURS else pa.concat_tables([head.slice(0, NEIGHBOURS), tail])
            empty = [pa.nulls(len(ends), t) for t in (pa.int64(), pa.int64(), pa.int32())]
            yield from pa.table(empty + ends.columns, ["a", "b", "agree"] + _SORTED).combine_chunks().to_batches()

    return run


def neighbour_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, agree): candidates of the sorted orders, a < b.

    Each range also hands on its first and last rows.  They are few, as ranges
    are, and put in order they give the pairs that a border parts: a range too
    small to fill both ends hands on all its rows, so pairs reach over it.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["order", "key", "deeper", "node"]
    placed = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    found = materialize(placed.mapInArrow(_following(threshold, True), f"{_PAIRS}, order byte, key long, deeper int, node long, n int, short binary"), "neighbours")
    ends = found.where("node is not null").select(*_SORTED).repartition(1).sortWithinPartitions(*keys)
    pairs = found.where("a is not null").select("a", "b", "agree").union(ends.mapInArrow(_following(threshold, False), _PAIRS))
    return pairs.groupBy("a", "b").agg(F.max("agree").alias("agree"))


def region_of(depth: int):
    """A number for the prefix of ``depth`` minima in an order."""
    prefix = [F.shiftrightunsigned("key", 64 - 16 * depth) if depth < 4 else F.col("key")]
    prefix += [F.shiftright("deeper", 15)] if depth == 5 else [F.col("deeper")] if depth == 6 else []
    return F.xxhash64("order", F.lit(depth), *prefix)


def with_totals(rows: DataFrame, key: str, partial: list, total: list) -> DataFrame:
    """``rows`` (with ``node``) and the totals over all rows of their key.

    Rows of one key are spread over SALTS keys: aggregated there, then in the few
    rows that come of it, and joined back by both.
    """
    salted = rows.withColumn("salt", F.pmod("node", F.lit(SALTS)))
    parts = salted.groupBy(key, "salt").agg(*partial)
    routed = parts.select(key, "salt").join(parts.groupBy(key).agg(*total), key)
    return salted.join(routed, [key, "salt"]).drop("salt")


def _sized(rows: DataFrame) -> DataFrame:
    """The rows of crowded regions, with the region's smallest node as its hub."""
    counted = [F.count(F.lit(1)).alias("size"), F.min("node").alias("hub")]
    return with_totals(rows, "region", counted, [F.sum("size").alias("size"), F.min("hub").alias("hub")]).where(f"size > {NEIGHBOURS + 1}").drop("size")


def crowded_rows(rows: DataFrame) -> DataFrame:
    """The rows of regions that are crowded at the depth where they are finished exactly."""
    rows = rows.select("order", "key", "deeper", "node", "n").withColumn("region", region_of(FINISH_DEPTH))
    return _sized(rows).drop("region", "hub")


def mixed_nodes(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label): all nodes of crowded regions that hold more than one component."""
    labelled = rows.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    placed = rows.select("node", region_of(FINISH_DEPTH).alias("region")).join(labelled, "node")
    ends = [F.min("label").alias("least"), F.max("label").alias("most")]
    mixed = with_totals(placed, "region", ends, [F.min("least").alias("least"), F.max("most").alias("most")]).where("least <> most")
    return mixed.select("node", "label").distinct()


def shingle_counts(texts: DataFrame, width: int, bits: int) -> np.ndarray:
    """How many sets hold a shingle, in 2^bits counters by its first bits; shingles may share one.

    A task adds up its own rows; parts of the counters are then added up apart.
    """
    parts = 1 << (bits - COUNTERS_A_PART)

    def count(batches):
        total = np.zeros(1 << bits, np.int32)
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                np.add.at(total, _counter(shingles(text, width), bits), 1)
        rows = total.reshape(parts, -1)
        full = np.flatnonzero(rows.any(axis=1))
        for some in (full[i : i + 256] for i in range(0, len(full), 256)):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([rows[k].tobytes() for k in some], pa.binary())], ["part", "counts"])

    def add(table):
        total = sum(np.frombuffer(c, np.int32).astype(np.int64) for c in table.column("counts").to_pylist())
        return pa.table({"part": table.column("part").slice(0, 1), "counts": pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})

    out = np.zeros((parts, 1 << COUNTERS_A_PART), np.int32)
    kind = "part int, counts binary"
    for part, counts in texts.select("text").mapInArrow(count, kind).groupBy("part").applyInArrow(add, kind).collect():
        out[part] = np.frombuffer(counts, np.int32)
    return out.ravel()


def _counter(found: np.ndarray, bits: int) -> np.ndarray:
    return (found >> np.uint64(64 - bits)).astype(np.int64)


def rare_shingles(texts: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """(shingle, node, label, n, pos): a set's rarest shingles, as many as any set linked with it must meet.

    Sets are put in one order, by count and shingle; which order it is matters
    for speed alone.
    """

    bits = len(counts).bit_length() - 1

    def run(batches):
        for batch in slices(batches):
            held, size = [], 0
            for text, node, label in zip(*(batch.column(c).to_pylist() for c in ("text", "node", "label")), strict=True):
                found = shingles(text, width)
                n = len(found)
                first = found[np.lexsort((found, counts[_counter(found, bits)]))][: n + percent * n // -100 + 1]
                held.append((first, node, label, n))
                size += len(first)
                if size > 200_000:
                    yield pack(held)
                    held, size = [], 0
            if held:
                yield pack(held)

    def pack(held):
        sizes = [len(h[0]) for h in held]
        spread = [np.repeat(np.array([h[k] for h in held], np.int64), sizes) for k in (1, 2, 3)]
        columns = [np.concatenate([h[0] for h in held]).view(np.int64), *spread, np.concatenate([np.arange(k) for k in sizes])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shingle", "node", "label", "n", "pos"])

    return texts.select("text", "node", "label").mapInArrow(run, "shingle long, node long, label long, n long, pos long")


def links_between(nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): every pair of nodes (node, label) with different labels that can be linked, by prefix filter.

    Of two linked sets the smaller has a shingle of the other among its first
    ones (those with ``index``), and behind the first that they share enough is
    left of both.  Pairs of a shingle's largest component are never formed, so a
    crowd of copies costs its rows; what a task holds is a sorted run of a join.
    """
    labelled = texts.join(nodes, "node")
    total = labelled.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_COUNTERS, max(LEAST_COUNTERS, (total // 4).bit_length()))
    counts = shingle_counts(labelled, width, bits)
    rare = materialize(rare_shingles(labelled, counts, width, percent), "rare-shingles")
    ends = [F.min("label").alias("least"), F.max("label").alias("most")]
    shared = with_totals(rare, "shingle", ends, [F.min("least").alias("least"), F.max("most").alias("most")]).where("least <> most").drop("least", "most")
    rare = materialize(shared, "shared-shingles")
    by_label = rare.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("c"))
    largest = by_label.groupBy("shingle").agg(F.max(F.struct("c", "label")).alias("top")).select("shingle", F.col("top.label").alias("top_label"))
    salts = F.pmod("node", F.lit(SALTS)).alias("salt")
    routed = rare.select("shingle", salts).distinct().join(largest, "shingle")
    marked = rare.withColumn("salt", salts).join(routed, ["shingle", "salt"]).withColumn("top", F.col("label") == F.col("top_label"))
    rare = materialize(marked.drop("top_label", "salt"), "shared-shingles")
    index = rare.where(f"(n - pos) * {100 + percent} >= {2 * percent} * n").alias("i")
    probe = rare.alias("q")
    fits = F.expr(f"""i.shingle = q.shingle and i.label <> q.label and (q.n > i.n or q.n = i.n and q.node > i.node)
        and least(i.n - i.pos, q.n - q.pos) * {100 + percent} >= {percent} * (i.n + q.n)""")
    ends = [F.least("i.node", "q.node").alias("a"), F.greatest("i.node", "q.node").alias("b")]
    odd = index.where("not i.top").join(probe, fits).select(*ends)
    even = index.where("i.top").join(probe.where("not q.top"), fits).select(*ends)
    return odd.union(even).distinct()


def agreements(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, agree): places in which the signatures of pairs agree."""

    def run(batches):
        for batch in slices(batches):
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint32).reshape(-1, HASHES) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((one == two).sum(axis=1).astype(np.int32))], ["a", "b", "agree"])

    signs = nodes.select("node", "minima")
    signed = pairs.join(signs.toDF("b", "minima_b"), "b").join(signs.toDF("a", "minima_a"), "a").select("a", "b", "minima_a", "minima_b")
    return signed.mapInArrow(run, "a long, b long, agree int")


def hub_pairs(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, agree): each node of a crowded region with two hubs in each order.

    One is the hub of the shallowest region here, one that of the deepest that is crowded: how deep, depends on how many nodes share its prefixes.
    Where many copies of one text crowd, these links join most of them at once.
    """
    at_depths = F.array(*(F.struct(F.lit(d).alias("depth"), region_of(d).alias("region")) for d in range(FINISH_DEPTH, LEVELS + 1)))
    each = rows.select("order", "node", F.explode(at_depths).alias("at")).select("order", "node", "at.depth", "at.region")
    hub = F.struct("depth", "hub")
    hubs = _sized(each).groupBy("order", "node").agg(F.array(F.min(hub), F.max(hub)).alias("hubs"))
    pairs = hubs.select(F.explode("hubs.hub").alias("a"), F.col("node").alias("b")).where("a < b")
    return agreements(pairs.distinct(), nodes).where(F.col("agree") >= LIKELY_AGREEMENT)


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on full sets."""

    def run(batches):
        last_text, last_set = None, None
        for batch in slices(batches):
            keep = []
            for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if one != last_text:
                    last_text, last_set = one, shingles(one, width)
                other = shingles(two, width)
                both = np.intersect1d(last_set, other, assume_unique=True).size
                keep.append(100 * both >= percent * (len(last_set) + len(other) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    first = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.select("a", "b").join(second, "b").join(first, "a").select("a", "b", "text_a", "text_b")
    return materialize(joined.mapInArrow(run, "a long, b long").distinct(), "confirmed")


def apart_ends(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components."""
    label_a, label_b = labels.toDF("a", "la"), labels.toDF("b", "lb")
    return pairs.join(label_a, "a", "left").join(label_b, "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def merged_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (node, label) after more links (a, b)."""
    label_a, label_b = labels.toDF("a", "la"), labels.toDF("b", "lb")
    # Components of components: only links between them are left.
    bridges = links.join(label_a, "a", "left").join(label_b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    merged = connected_components(bridges).toDF("label", "merged")
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).union(labels.select("node")).distinct()
    joined = ends.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.pmod("node", F.lit(SALTS)).alias("salt"))
    routed = joined.select("label", "salt").distinct().join(merged, "label")
    return materialize(joined.join(routed, ["label", "salt"], "left").select("node", F.coalesce("merged", "label").alias("label")), "labels")


def classes(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, n_links of each row.

    n_links counts the confirmed links of the row's set that were looked at; a
    component is joined by at least as many as it needs.
    """
    rows = materialize(signatures(df, width, id_col, text_col).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), "signatures")
    worded = rows.where("digest is not null")
    # Equal sets become one node; a set with very many copies is summed up before it moves.
    of_set = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "n_shingles", "minima")).alias("first")
    nodes = worded.groupBy("digest").agg(of_set).select("digest", "first.doc_id", "first.text_hash", "first.n_shingles", "first.minima")
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    text = text_or_empty(text_col)
    source = df.select(F.col(id_col), text.alias("text"), F.xxhash64(text).alias("text_hash"))

    pairs = materialize(neighbour_pairs(forest_rows(nodes), percent / 100), "candidates")
    crowd = materialize(crowded_rows(forest_rows(nodes)), "crowded-rows")
    # Texts of all nodes that may be compared, fetched once.
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(crowd.select("node")).distinct()
    wanted = nodes.join(ends, "node", "left_semi").select("node", F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    same_row = (source["text_hash"] == wanted["__hash"]) & source[id_col].eqNullSafe(wanted["__id"])
    texts = materialize(source.join(wanted, same_row).select("node", "text"), "candidate-texts")

    # First: of each node the most similar candidate and the smallest, and the two most similar hubs.
    sides = pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "agree").union(pairs.select("b", "a", "agree"))
    picked = sides.groupBy("node").agg(F.max(F.struct("agree", "other")).alias("best"), F.min("other").alias("least"))
    picked = picked.select("node", F.explode(F.array("best.other", "least")).alias("other"))
    picked = picked.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    near = hub_pairs(crowd, nodes).groupBy("b").agg(F.max(F.struct("agree", "a")).alias("first"), F.min("a").alias("least"))
    near = near.select(F.explode(F.array("first.a", "least")).alias("a"), "b")
    picked = materialize(picked.union(near).distinct(), "picked")
    confirmed, tried = confirm(picked, texts, width, percent), picked
    labels = connected_components(confirmed)

    # Then: all other candidates whose ends are still in different components.
    others = pairs.select("a", "b").join(tried, ["a", "b"], "left_anti")
    apart = materialize(apart_ends(others, labels), "apart")
    tried = tried.union(apart)
    more = confirm(apart, texts, width, percent)
    confirmed, labels = confirmed.union(more), merged_labels(labels, more)
    # Last: all links between components of a crowded region.
    mixed = materialize(mixed_nodes(crowd, labels), "mixed")
    between = materialize(links_between(mixed, texts, width, percent).join(tried, ["a", "b"], "left_anti"), "between")
    more = confirm(between, texts, width, percent)
    confirmed, labels = confirmed.union(more), merged_labels(labels, more)

    links = confirmed.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    named = nodes.select("node", "digest", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = [F.min("doc_id").alias("component_id")]
    named = with_totals(named, "label", smallest, [F.min("component_id").alias("component_id")]).join(links, "node", "left").select("digest", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # Copies of one set are spread over SALTS keys before the verdict is joined to them.
    routed = worded.select("digest", "salt").distinct().join(named, "digest")
    joined = worded.join(routed, ["digest", "salt"]).select("doc_id", "text_hash", "n_shingles", "component_id", "n_links")
    alone = rows.where("digest is null").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return joined.union(alone)


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, n_links of each row; a component keeps its smallest id."""
    found = classes(df, width, percent, id_col, text_col)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "n_links")


def keep_one_per_class(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: one of each component."""
    found = classes(df, width, percent, id_col, text_col)
    key = free_names(df, "hash", "place")
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("text_hash").alias(key[0]), id_place("doc_id").alias(key[1]))
    # Neither key is ever null, so repeated rows are dropped where the join has put them.
    rows = df.withColumns({key[0]: F.xxhash64(text_or_empty(text_col)), key[1]: id_place(id_col)})
    return rows.join(stay, key, "left_semi").dropDuplicates(key).select(*(f"`{c}`" for c in df.columns))
