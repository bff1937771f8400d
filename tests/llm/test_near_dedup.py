import random

import numpy as np
import pytest
from conftest import DATA
from helpers import EDGES, docs
from pyspark.sql import functions as F

from kinetrace.llm import graphs, near_dedup, queries
from kinetrace.llm.near_dedup import shingles


def plain_sets(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def brute(pairs, width):
    """Component ids by comparing everything."""
    sets = [plain_sets(t, width) for _, t in pairs]
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    smallest = {}
    for k, (i, _) in enumerate(pairs):
        if sets[k] and i is not None:
            smallest[find(k)] = min(smallest.get(find(k), i), i)
    return sorted((str(i), len(sets[k]), str(smallest.get(find(k), i) if sets[k] else i)) for k, (i, _) in enumerate(pairs))


def found(df, width):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_dedup.near_duplicates(df, width).collect())


def test_whole_table(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    pairs = [(r.doc_id, r.text) for r in table.collect()]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in queries.op2_near_dedup(spark, DATA).collect())
    assert got == brute(pairs, 2)


@pytest.mark.parametrize("width", [2, 5])
def test_edges(spark, width):
    pairs = [*EDGES, (20, "one"), (21, "One"), (22, "one two"), (23, "ONE TWO"), (24, dict(EDGES)[7] + " tail")]
    assert found(docs(spark, pairs), width) == brute(pairs, width)


def test_crowd_of_near_copies(spark):
    """A crowd around one text, outliers near its edge, and other texts."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    pairs = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.randrange(0, 16)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        pairs.append((i, " ".join(words)))
    pairs += [(1000 + i, " ".join(f"z{rng.randrange(10**6)}" for _ in range(40))) for i in range(60)]
    assert found(docs(spark, pairs), 2) == brute(pairs, 2)


def test_empty_table(spark):
    assert near_dedup.near_duplicates(docs(spark, EDGES).limit(0)).count() == 0


def test_kept_rows(spark):
    df = docs(spark, [(3, "a b c d e f g"), (4, "a b c d e f g"), (5, ""), (6, None), (6, None)])
    df = df.selectExpr("*", "'mine' as hash", "'too' as place", "'three' as `a.b`")
    kept = near_dedup.keep_one_per_class(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 5, 6]


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.node: r.label for r in graphs.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[i] for i in range(31)}) == 1 and got[100] == got[102] != got[0] and len(got) == 34


def test_shingles_and_minima():
    assert len(shingles("a b a b", 2)) == 2 and len(shingles("", 2)) == 0 and len(shingles("x", 5)) == 1
    rng = np.random.default_rng(0)
    one = rng.integers(1 << 62, size=4000, dtype=np.uint64)
    other = np.concatenate([one[:3600], rng.integers(1 << 62, size=400, dtype=np.uint64)])
    signs = near_dedup.minima([one, other])
    assert abs((signs[0] == signs[1]).mean() - 3600 / 4400) < 0.15


def test_more_ranges_than_rows(spark):
    """Pairs meet over the borders of ranges, however many ranges there are."""
    rng = random.Random(9)
    pairs = []
    for i in range(6):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        pairs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], f"n{i}"]))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "250")
    try:
        nodes = near_dedup.signatures(docs(spark, pairs), 2, "doc_id", "text").withColumn("node", F.col("doc_id"))
        met = {(r.a, r.b) for r in near_dedup.neighbour_pairs(near_dedup.forest_rows(nodes), 0.8).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert met >= {(2 * i, 2 * i + 1) for i in range(6)}


def test_crowd_of_small_components(spark):
    """Forms share a long passage: many pairs in the same regions, each its own component."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(160)]
    pairs = []
    for i in range(600):
        own = [f"o{i}x{k}" for k in range(40)]
        other = [*own[:21], *(f"n{i}x{k}" for k in range(19))]
        pairs += [(2 * i, " ".join(passage + own)), (2 * i + 1, " ".join(passage + other))]
    rng.shuffle(pairs)
    assert found(docs(spark, pairs), 2) == brute(pairs, 2)


def test_partitions_do_not_matter(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        test_whole_table(spark)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_totals_of_a_hot_key(spark):
    rows = spark.range(1000).selectExpr("id as node", "if(id < 900, 1L, id) as region")
    got = near_dedup.with_totals(rows, "region", [F.count(F.lit(1)).alias("n")], [F.sum("n").alias("n")])
    assert got.count() == 1000 and {r.n for r in got.where("region = 1").collect()} == {900}


def test_hubs_go_as_deep_as_the_crowd(spark):
    """Two crowds that part below the depth at which regions are finished: a node meets the hub of its own."""
    schema = "order byte, key long, deeper int, node long, n int"
    rows = spark.createDataFrame([(0, (5 << 48) | (6 << 32) | (7 << 16) | 8, k % 2 << 15, k, 10) for k in range(40)], schema)
    nodes = rows.selectExpr("node", "unhex(repeat('00', 256)) as minima")
    got = {(r.a, r.b) for r in near_dedup.hub_pairs(rows, nodes).collect()}
    assert got == {(0, k) for k in range(1, 40)} | {(1, k) for k in range(3, 40, 2)}
