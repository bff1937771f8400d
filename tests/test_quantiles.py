"""Exact quantiles against the aggregate that keeps all values."""

import random

import pytest
from pyspark.sql import functions as F

from kinetrace.operators.quantiles import exact_quantiles, left_out_quantiles

SHARES = [0.0, 0.01, 0.25, 0.5, 0.95, 0.99, 1.0]


@pytest.fixture(scope="module")
def numbers(spark):
    """A large group, one with many ties, a small one, one row, nulls alone, and a null key."""
    rng = random.Random(3)
    rows = [("large", rng.gauss(9.8, 0.1)) for _ in range(60_000)] + [("ties", float(rng.choice([1, 1, 1, 2, 5]))) for _ in range(20_000)]
    rows += [("small", x) for x in (3.0, 1.0, 2.0)] + [("one", 7.0), ("none", None), (None, 4.0), (None, 6.0), ("small", None)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "name string, x double").repartition(7).cache()


def test_by_group(numbers):
    got = {r["name"]: r.q for r in exact_quantiles(numbers, ["name"], "x", SHARES).collect()}
    want = {r["name"]: r.q for r in numbers.where("x is not null").groupBy("name").agg(F.percentile("x", F.array(*map(F.lit, SHARES))).alias("q")).collect()}
    assert got == want


def test_whole_table_and_empty(numbers):
    got = exact_quantiles(numbers, [], "x", SHARES).first().q
    assert got == numbers.agg(F.percentile("x", F.array(*map(F.lit, SHARES))).alias("q")).first().q
    assert exact_quantiles(numbers.limit(0), ["name"], "x", [0.5]).count() == 0


def test_nearest_rank(numbers):
    got = {r["name"]: r.q[0] for r in exact_quantiles(numbers, ["name"], "x", [0.95], nearest=True).collect()}
    want = {r["name"]: r.q for r in numbers.where("x is not null").groupBy("name").agg(F.expr("percentile_disc(0.95) within group (order by x)").alias("q")).collect()}
    assert got == want


@pytest.mark.parametrize("by", [["name"], []])
def test_large_groups_are_parted_again(numbers, by):
    """With a small bound every group takes the way of the largest."""
    got = {tuple(r[:-1]): r.q for r in exact_quantiles(numbers, by, "x", SHARES, most=1).collect()}
    want = {tuple(r[:-1]): r.q for r in numbers.where("x is not null").groupBy(*by).agg(F.percentile("x", F.array(*map(F.lit, SHARES))).alias("q")).collect()}
    assert got == want


def test_nearest_rank_of_large_groups(numbers):
    got = {r["name"]: r.q[0] for r in exact_quantiles(numbers, ["name"], "x", [0.95], nearest=True, most=1).collect()}
    assert got == {r["name"]: r.q[0] for r in exact_quantiles(numbers, ["name"], "x", [0.95], nearest=True).collect()}


@pytest.mark.parametrize("most", [3, 2_000, 10**9])
def test_quantiles_of_all_but_one_part(spark, most):
    """Parts of a third of all rows, of one row, of none; ties, infinities and NaN; a group that is one part."""
    rng = random.Random(5)
    rows = [("a", "big", rng.gauss(0, 1)) for _ in range(9_000)] + [("a", f"p{i % 7}", rng.choice([0.0, 1.0, rng.gauss(1, 9)])) for i in range(18_000)]
    rows += [("a", "lone", 1e300), ("a", "lone2", float("inf")), ("b", "big", 2.0), ("b", "p1", float("nan")), ("b", "p1", 2.0), ("c", "p1", 5.0), ("a", "p1", None)]
    values = spark.createDataFrame(rows, "g string, part string, x double").repartition(5)
    parts = spark.createDataFrame([(g, p) for g in "abcd" for p in ("big", "lone", "lone2", "p1", "p6", "absent")], "g string, part string")
    got = {(r.g, r.part): r.q for r in left_out_quantiles(values, SHARES, parts=parts, most=most).collect()}
    others = parts.join(values.withColumnRenamed("part", "from"), "g").where("from <> part and x is not null")
    want = {(r.g, r.part): r.q for r in others.groupBy("g", "part").agg(F.percentile("x", F.array(*map(F.lit, SHARES))).alias("q")).collect()}
    assert ("c", "p1") not in got and ("c", "absent") in got
    assert {k: str(v) for k, v in got.items()} == {k: str(v) for k, v in want.items()}
