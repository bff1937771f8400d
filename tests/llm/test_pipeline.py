"""Each stage against a plain version of it, on its own input."""

from conftest import DATA
from helpers import EDGES
from helpers import docs as edge_docs
from test_near_dedup import brute

import corpus_pipeline
from kinetrace.llm import toxicity
from kinetrace.llm.common import id_remainder


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "packing"]

    clean = stages["toxicity"](spark, docs, DATA).cache()
    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"), id_remainder(4) != 2)
    weights = model.table()
    want = {r.doc_id for r in docs.collect() if toxicity.noisy_or(toxicity.sentence_logits(r.text, weights, model.bias)) < 0.3}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == want

    once = stages["exact_dedup"](spark, clean, DATA).cache()
    last = {}
    for r in clean.collect():
        last[r.text] = max(last.get(r.text, r.doc_id), r.doc_id)
    assert once.columns == docs.columns and sorted(r.doc_id for r in once.collect()) == sorted(last.values())

    apart = stages["near_dedup"](spark, once, DATA).cache()
    classes = brute([(r.doc_id, r.text) for r in once.collect()], 5)
    assert apart.columns == docs.columns and sorted(str(r.doc_id) for r in apart.collect()) == sorted({c for _, _, c in classes})

    packed = stages["packing"](spark, apart, DATA)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in apart.collect()}


def test_run_and_extra_columns(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    docs = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("*", "'x' as digest", "1 as node", "2 as salt", "'k' as text_hash", "'d' as __digest", "3 as place", "'h' as hash")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.count() > 0


def test_edges(spark):
    """Nulls, empty and long texts, ties, repeated rows, and a table without rows."""
    docs = edge_docs(spark, EDGES)
    stages = dict(corpus_pipeline.STAGES)
    assert stages["toxicity"](spark, docs, DATA).count() == len(EDGES)
    assert sorted(str(r.doc_id) for r in stages["exact_dedup"](spark, docs, DATA).collect()) == ["2", "3", "5", "6", "7", "8", "None"]
    assert sorted(str(r.doc_id) for r in stages["near_dedup"](spark, docs, DATA).collect()) == ["1", "2", "3", "4", "6", "7", "8", "None"]
    packed = stages["packing"](spark, docs, DATA)
    assert packed.groupBy("doc_id").count().count() == len({i for i, _ in EDGES})
    for name, stage in stages.items():
        assert stage(spark, docs.limit(0), DATA).count() == 0, name


def test_tables_of_words_stay_small():
    """What a worker keeps of words, for stages that come after as well."""
    import sys

    import numpy as np

    from kinetrace.llm import near_dedup, toxicity

    size = lambda table: sys.getsizeof(table) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in table.items())
    tables = [near_dedup._WordHashes(), toxicity.Model(np.array([], dtype=np.uint64), np.array([]), 0.0).table()]
    most = 0
    for table in tables:
        for i in range(400_000):
            table[b"word-%d" % i]
            most = max(most, len(table))
    assert sum(map(size, tables)) < 40e6 and most < 200_000


def test_batches_to_workers_are_short(spark):
    """Texts go to workers in short batches, and the session's setting is put back."""
    import pyarrow as pa

    from kinetrace.llm.common import BATCH_SETTING, materialize

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    before = spark.conf.get(BATCH_SETTING)
    got = materialize(spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long"), "sizes").agg({"n": "max", "*": "count"}).first()
    assert sorted(got) == [5, 1000] and spark.conf.get(BATCH_SETTING) == before
