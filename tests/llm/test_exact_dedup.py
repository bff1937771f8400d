import hashlib
import uuid

import pytest
from compare import duck_rows, spark_rows
from conftest import DATA
from helpers import EDGES, docs, rows
from pyspark.sql import functions as F

from kinetrace.llm import exact_dedup, queries


def index(spark):
    return exact_dedup.DigestIndex(spark, f"t{uuid.uuid4().hex}", 4)


def test_against_sql(spark, duck):
    df = queries.op3_exact_dedup(spark, DATA)
    names, want = duck_rows(duck, queries.oracle_sql()["op3_exact_dedup"])
    assert sorted(df.columns) == names and spark_rows(df) == want


def test_edges(spark):
    df = index(spark).add(docs(spark, EDGES))
    got = df.collect()
    assert len(got) == len(EDGES)
    by_text = {}
    for i, t in EDGES:
        by_text.setdefault(hashlib.sha256((t or "").encode()).digest(), []).append(i)
    assert sum(r.kept for r in got) == len(by_text)
    for r in got:
        own = by_text[bytes(r.digest)]
        assert r.group_size == len(own)
        assert r.keep_id == max((i for i in own if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id


def test_empty_table(spark):
    assert index(spark).add(docs(spark, EDGES).limit(0)).count() == 0
    assert exact_dedup.keep_one_per_text(docs(spark, EDGES).limit(0), index(spark)).count() == 0


def test_later_batches_meet_earlier_ones(spark):
    i = index(spark)
    i.add(docs(spark, {1: "a", 2: "b"}), "one").count()
    second = i.add(docs(spark, {3: "a", 4: "c", 5: "c"}), "two")
    assert rows(second, "doc_id", "keep_id", "group_size", "kept") == [(3, 1, 2, False), (4, 5, 2, False), (5, 5, 2, True)]
    third = i.add(docs(spark, {9: "a"}), "three")
    assert rows(third, "doc_id", "keep_id", "group_size", "kept") == [(9, 1, 3, False)]
    assert i.read().where("first").count() == 3 == i.read().where("first").select("digest").distinct().count()


def test_a_batch_added_again_has_the_same_verdicts(spark):
    i, batch = index(spark), docs(spark, {1: "a", 2: "a", 3: "b"})
    i.add(docs(spark, {0: "b"}), "before")
    once = rows(i.add(batch, "batch"), "doc_id", "keep_id", "group_size", "kept")
    size = i.read().count()
    assert rows(i.add(batch, "batch"), "doc_id", "keep_id", "group_size", "kept") == once == [(1, 2, 2, False), (2, 2, 2, True), (3, 0, 2, False)]
    assert i.read().count() == size


def test_half_of_an_append_is_completed(spark):
    i = index(spark)
    i.add(docs(spark, {0: "z"}), "before")
    i.add(docs(spark, {1: "a"}), "batch")  # of the batch below, one row came through
    assert rows(i.add(docs(spark, {1: "a", 2: "b"}), "batch"), "doc_id", "keep_id", "kept") == [(1, 1, True), (2, 2, True)]
    assert i.read().count() == 3


def test_compacted_index_knows_the_same(spark):
    i = index(spark)
    for k in range(3):
        i.add(docs(spark, {10 * k + 1: "a", 10 * k + 2: f"own {k}"}), f"b{k}")
    i.compact()
    assert i.read().count() == 4 and rows(i.totals(), "keep_id", "copies") == [(1, 3), (12, 1), (2, 1), (22, 1)]
    assert rows(i.add(docs(spark, {99: "a"}), "last"), "keep_id", "group_size", "kept") == [(1, 4, False)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_anti_join_moves_and_sorts_the_batch_alone(spark):
    """A sort-merge anti-join, whose only exchange and only sort are on the batch's side."""
    i = index(spark)
    i.add(docs(spark, {n: f"text {n}" for n in range(50)}), "one")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with exact_dedup.trusted_order(spark):
            plan = plan_of(i.unseen(exact_dedup.digest_rows(docs(spark, {1: "a"})), "two"))
            i.add(docs(spark, {n: f"text {n}" for n in range(9)}), "two")
            i.compact()
            compacted = plan_of(i.unseen(exact_dedup.digest_rows(docs(spark, {1: "a"})), "three"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert spark.conf.get(exact_dedup.ORDERED_BUCKETS, "false") == "false"
    for text in (plan, compacted):
        join = text[text.index("SortMergeJoin") :]
        assert "LeftAnti" in join.splitlines()[0]
        assert join.count("Exchange hashpartitioning") == 1 == join.count("Sort [digest")


@pytest.mark.parametrize("kind", ["string", "long", "decimal(38,0)", "timestamp", "double"])
def test_ids_of_any_order_are_parted(spark, kind):
    """Text ids, and ids at the ends of what a type holds."""
    ids = {"string": ["a", "b", "zz", "ä", ""], "long": [2**63 - 1, 2**63 - 2, -(2**63), 0, 5], "decimal(38,0)": [10**37, -(10**37), 0, 1, 2], "timestamp": [f"20{k}0-01-01" for k in range(5)], "double": [1.5, -2.0, 1e308, -1e308, 0.0]}[kind]
    df = spark.createDataFrame([(str(i), f"text {k % 2}") for k, i in enumerate(ids)], "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    upper, lower = exact_dedup.halves(df)
    assert 0 < upper.count() < 5 and upper.count() + lower.count() == 5
    assert upper.agg(F.min("doc_id")).first()[0] > lower.agg(F.max("doc_id")).first()[0]
    got = exact_dedup.deduplicate(df, index(spark)).collect()
    largest = {r.text: r.m for r in df.groupBy("text").agg(F.max("doc_id").alias("m")).collect()}
    assert sorted(r.doc_id for r in got if r.kept) == sorted(largest.values())
    assert sorted(r.doc_id for r in exact_dedup.keep_one_per_text(df, index(spark)).collect()) == sorted(largest.values())


def test_compaction_that_was_cut_off(spark):
    i = index(spark)
    i.add(docs(spark, {1: "a", 2: "b"}), "one")
    spark.sql(f"ALTER TABLE {i.table} RENAME TO {i._former}")  # the job ended after this step
    assert rows(i.add(docs(spark, {3: "a"}), "two"), "keep_id", "group_size", "kept") == [(1, 2, False)]
    i.compact()
    i.drop()
    assert not i.exists()


def test_scratch_index_lies_in_the_shared_folder(spark):
    i = exact_dedup.scratch_index(spark)
    i.add(docs(spark, {1: "a"}))
    where = spark.sql(f"DESCRIBE EXTENDED {i.table}").where("col_name = 'Location'").first()["data_type"]
    assert where.split(":", 1)[1].startswith(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    i.drop()


def test_second_half_meets_the_first(spark):
    i = index(spark)
    got = exact_dedup.deduplicate(docs(spark, {1: "a", 2: "b", 8: "a", 9: "c"}), i)
    assert rows(got, "doc_id", "keep_id", "group_size", "kept") == [(1, 8, 2, False), (2, 2, 1, True), (8, 8, 2, True), (9, 9, 1, True)]
    assert i.read().where("not first").count() == 1


def test_hot_text_is_spread(spark):
    many = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 > 0, 'copy', cast(id as string)) as text")
    df = exact_dedup.deduplicate(many, index(spark))
    assert df.where("kept").count() == 1001 and df.where("group_size = 2000").count() == 2000


def test_kept_rows_have_all_columns(spark):
    df = docs(spark, EDGES).selectExpr("*", "'mine' as __digest", "'too' as place", "'three' as `a.b`")
    kept = exact_dedup.keep_one_per_text(df, index(spark))
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "5", "6", "7", "8", "None"]
    assert {r["digest"] + r["__digest"] + r["place"] + r["a.b"] for r in kept.collect()} == {"dminetoothree"}
