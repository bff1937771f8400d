"""Embedding operators against brute force, SQL and numpy."""

import numpy as np
import pytest
from compare import duck_rows, spark_rows
from conftest import DATA
from pyspark.sql import functions as F

from kinetrace.llm import embedding_dedup, hard_negatives, queries, whitening

#: Names that operators use inside.
MORE = ", 'x' as node, 1 as weight, 'y' as v, 2 as `a.b`, 3 as part"


def table(spark, rows):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], g) for i, v, g in rows], "vec_id long, embedding array<double>, label int")
    return df.selectExpr("*", *MORE.strip(", ").split(", ")).repartition(5)


def fits(v):
    return bool(v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v))


@pytest.mark.parametrize("name", ["op11_embedding_dedup", "op13_hard_negatives"])
def test_against_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    names, want = duck_rows(duck, queries.oracle_sql()[name])
    assert sorted(df.columns) == names and spark_rows(df) == want and want


# --- near duplicates -------------------------------------------------------


def brute_links(rows, cosine):
    n = len(rows)
    ok = [fits(v) and any(v) and g is not None for _, v, g in rows]
    parent, degree = list(range(n)), [0] * n

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine:
                    degree[a], degree[b] = degree[a] + 1, degree[b] + 1
                    parent[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least.setdefault(find(k), [])
        if i is not None:
            least[find(k)].append(i)
    out = []
    for k, (i, _, _) in enumerate(rows):
        c = min(least[find(k)], default=None)
        out.append((i, degree[k], c, i == c))
    return sorted(out, key=str)


def links(df, **more):
    return sorted((tuple(r) for r in embedding_dedup.near_duplicates(df, **more).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def crowd(rng, n, dim, noise, base=None):
    base = rng.normal(size=dim) if base is None else base
    return base / np.linalg.norm(base) + rng.normal(size=(n, dim)) * noise / np.sqrt(dim)


@pytest.mark.parametrize(("dim", "cosine"), [(64, 0.98), (21, 0.95), (8, 0.999)])
def test_links_are_those_of_all_pairs(spark, dim, cosine):
    """Crowds whose pairs lie on both sides of the threshold, and chains."""
    rng = np.random.default_rng(dim)
    apart = np.sqrt(2 - 2 * cosine)
    vectors = [*crowd(rng, 120, dim, 0.7 * apart), *crowd(rng, 60, dim, 0.1 * apart), *rng.normal(size=(60, dim))]
    step = crowd(rng, 1, dim, 0)[0]
    for _ in range(20):
        step = step + crowd(rng, 1, dim, 0)[0] * apart * 0.9
        step = step / np.linalg.norm(step)
        vectors.append(step * rng.uniform(0.1, 50))
    rows = [(k, v.tolist(), k % 2) for k, v in enumerate(vectors)]
    want = brute_links(rows, cosine)
    assert links(table(spark, rows), cosine=cosine) == want
    assert 100 < sum(r[1] for r in want)


def test_crowded_cells_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = [(k, v.tolist(), 1) for k, v in enumerate([*crowd(rng, 150, 64, 0.13), *rng.normal(size=(20, 64))])]
    assert links(table(spark, rows)) == brute_links(rows, 0.98)


def test_link_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, [2.0, 4.0, 6.0], 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [0.0, 0.0, 0.0], 1), (9, [1.0, None, 3.0], 1), (10, [1.0, float("nan"), 3.0], 1), (11, [1.0, float("inf"), 3.0], 1)]
    rows += [(12, [1.0, 2.0], 1), (13, [1.0, 2.0], 1), (None, v, 1), (None, [5.0, -1.0, 0.0], 1), (14, [1e200, 2e200, 3e200], 3), (15, [1e-200, 2e-200, 3e-200], 3), (16, v, 1), (16, v, 1)]
    want = brute_links([r if r[0] not in (14, 15) else (r[0], v, 3) for r in rows], 0.98)
    assert links(table(spark, rows)) == [tuple(True if k == 3 and r[0] is None and r[2] is None else c for k, c in enumerate(r)) for r in want]
    assert links(table(spark, rows).limit(0)) == []


@pytest.mark.parametrize("reach", [1 / embedding_dedup.CELL, 0.4])
def test_probes_reach_all_that_is_near(reach):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4000, 8)) * 2
    step = rng.normal(size=x.shape)
    y = x + step / np.linalg.norm(step, axis=1)[:, None] * reach * 0.999999
    cells, others = embedding_dedup.decode(x), embedding_dedup.decode(y)
    row, points = embedding_dedup.probes(x, cells, reach)
    reached = {(r, *p) for r, p in zip(row.tolist(), points.tolist(), strict=True)} | {(r, *p) for r, p in enumerate(cells.tolist())}
    assert all((r, *p) in reached for r, p in enumerate(others.tolist()))
    assert (np.abs(cells - others).sum(axis=1) > 0).mean() > 0.3


def test_decoding_finds_the_nearest_point():
    points, lengths = embedding_dedup.near_points()
    assert len(points) == 2400 and set(np.round(lengths**2)) == {2.0, 4.0}
    x = np.random.default_rng(1).normal(size=(500, 8)) * 3
    cells = embedding_dedup.decode(x)
    own = ((x - cells) ** 2).sum(axis=1)
    around = ((x[:, None] - cells[:, None] - points[None]) ** 2).sum(axis=2)
    assert (own <= around.min(axis=1) + 1e-9).all() and own.max() <= 1 + 1e-9


# --- whitening -------------------------------------------------------------


def whitened(rows, keep=8):
    """(id, component) -> values, by numpy on all rows."""
    rows = [(i, v) for i, v, _ in rows if fits(v)]
    lengths = [len(v) for _, v in rows]
    dim = max(set(lengths), key=lambda d: (lengths.count(d), d))
    rows = [(i, v) for i, v in rows if len(v) == dim]
    x = np.floor(1024 * np.array([v for _, v in rows], float)).astype(int) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    cov = c.T @ c / n
    values, vectors = np.linalg.eigh(cov)
    order = [k for k in np.argsort(values)[::-1][:keep] if values[k] > 1e-12 * np.trace(cov)]
    out = c @ vectors[:, order] / np.sqrt(values[order])
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    return rows, n, deviation, out, values[order] / np.trace(cov)


def compare_whitened(df, rows):
    good, n, deviation, out, share = whitened(rows)
    got = {(r.vec_id, r.component): r for r in df.collect()}
    assert len(got) == len(good) * len(share) == df.count()
    for c in range(len(share)):
        mine = np.array([got[i, c + 1].whitened for i, _ in good])
        sign = np.sign(mine @ out[:, c])
        assert np.allclose(mine, sign * out[:, c], atol=1e-7)
        assert np.allclose(np.cov(mine, bias=True), 1, atol=1e-6)
    for (i, _), d in zip(good, deviation, strict=True):
        for c in range(len(share)):
            r = got[i, c + 1]
            assert (r.n, r.deviation) == (n, d) and r.explained == pytest.approx(share[c], rel=1e-9) and 0 <= r.identity_error < 1e-9


def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    compare_whitened(queries.op12_whitening(spark, DATA), rows)


def test_whitening_edges(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=5).tolist(), None) for k in range(40)]
    rows += [(50, None, 1), (51, [], 1), (52, [1.0, None, 0, 0, 0], 1), (53, [float("nan")] * 5, 1), (54, [float("-inf")] * 5, 1), (55, [1.0, 2.0], 1)]
    compare_whitened(whitening.whiten(table(spark, rows)), rows)
    assert whitening.whiten(table(spark, rows).limit(0)).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0], 1)] * 3)).count() == 0  # no variance
    flat = [(k, [float(k), 2.0 * k, 7.0], 1) for k in range(9)]  # one direction has all the variance
    compare_whitened(whitening.whiten(table(spark, flat)), flat)
    repeated = whitening.whiten(table(spark, [(None, [1.0, 2.0], 1), (1, [3.0, 0.5], 1), (1, [3.0, 0.5], 1)]))
    assert repeated.count() == 3 and repeated.where("vec_id is null").count() == 1


def test_deviations_are_exact_or_null():
    model = whitening.Whitening(3, np.array([6.0, 3e15]), np.eye(2), 2)
    assert whitening.deviations(model, np.array([[1.0, 1e15], [5.0, 1e15 + 2], [0.0, 4e15]])) == [9, 117, None]


def test_merging_does_not_depend_on_partitions():
    x = np.random.default_rng(4).normal(size=(1000, 6)) * 5 + 1e5
    parts = [whitening.moments(b) for b in np.array_split(x, [1, 2, 50, 700])]
    merged = parts[0]
    for p in parts[1:]:
        merged = whitening.merge(p, merged)
    assert merged[0] == 1000 and np.allclose(merged[3] / 1000, np.cov(x.T, bias=True), rtol=1e-10)


# --- hard negatives --------------------------------------------------------


def brute_negatives(rows):
    good = [(i, np.floor(256 * np.array(v, float)).astype(int), g) for i, v, g in rows if i is not None and g is not None and fits(v)]
    out = []
    for i, v, g in good:
        if i % 3:
            continue
        scored = sorted((-int(v @ w), j, h) for j, w, h in good if len(w) == len(v))
        for p, j, _ in [s for s in scored if s[2] == g and s[1] != i][:5]:
            window = [s for s in scored if s[2] != g and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            out += [(i, j, k + 1, m, -p, -s) for k, (s, m, _) in enumerate(window)]
    return sorted(out)


def negatives(df, **more):
    df = hard_negatives.mine(df, F.col("vec_id") % 3 == 0, F.col("label"), **more)
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("anchors", [7, 1000])
def test_negatives_are_those_of_all_products(spark, monkeypatch, anchors):
    """Few different components, so that many scores are equal; several groups and blocks of anchors."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    rng = np.random.default_rng(9)
    rows = [(k, (rng.integers(-1, 4, size=3) / 4).tolist(), int(rng.integers(3))) for k in range(140)]
    want = brute_negatives(rows)
    assert negatives(table(spark, rows), anchors=anchors) == want and len(want) > 500


def test_negative_edges(spark):
    v = [0.5, 0.25]
    rows = [(0, v, 1), (1, v, 1), (2, [0.4, 0.1], 2), (3, None, 1), (4, v, None), (5, [None, 1.0], 2), (6, [float("nan"), 1.0], 2), (None, v, 2), (9, [1.0, 1.0, 1.0], 1), (12, [1.0, 1.0, 1.0], 5), (15, [], 1), (18, [-0.5, -0.5], 1), (1, v, 1)]
    got = negatives(table(spark, rows))
    assert got == brute_negatives(rows) and {r[0] for r in got} == {0}
    assert negatives(table(spark, rows).limit(0)) == [] == negatives(table(spark, rows).where("vec_id = 1"))


def test_products_beyond_doubles_stop_the_job(spark):
    with pytest.raises(Exception, match="too large"):
        negatives(table(spark, [(0, [1e7, 1.0], 1), (1, [1e7, 1.0], 1)]))
