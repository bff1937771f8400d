import random

from conftest import DATA
from helpers import EDGES, docs

from kinetrace.llm import queries, toxicity
from kinetrace.llm.common import id_remainder


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        sentences = [" ".join(f"w{rng.randrange(300)}" for _ in range(8)) for _ in range(rng.randrange(1, 12))]
        bad = i % 4 == 0
        if bad:
            sentences[rng.randrange(len(sentences))] += f" vile{rng.choice(['ness', 'ly', 'r'])}"
        rows.append((i, ". ".join(sentences) + ".", int(bad)))
    return rows


def test_held_out_documents(spark):
    rows = corpus()
    df = docs(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(spark, df, labels).collect()}
    right = [int(got[i].predicted == y) for i, _, y in rows if got[i].held_out]
    assert len(right) > 50 and sum(right) / len(right) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_sentences_are_located(spark):
    rows = corpus()
    model = toxicity.fit([(y, t) for _, t, y in rows])
    text = "All is fine here. This is vileness indeed! More words."
    found = toxicity.offending_sentences(docs(spark, {1: text, 2: "w1 w2."}), model).collect()
    assert [(r.doc_id, text.encode()[r.start : r.end].strip()) for r in found] == [(1, b"This is vileness indeed")]


def test_worst_sentence_comes_with_the_score(spark):
    rows = corpus()
    model = toxicity.fit([(y, t) for _, t, y in rows])
    text = "Vile is fine here. This is vileness indeed! Käse, vilely and vileness again. More words."
    found = {r.doc_id: r for r in toxicity.score(docs(spark, {1: text, 2: "w1 w2.", 3: None}), model).collect()}
    assert text.encode()[found[1].worst_start : found[1].worst_end].strip().startswith("Käse".encode())
    assert found[1].worst_score <= found[1].score and found[1].predicted == 1
    assert all(found[k].worst_start is None and found[k].worst_score is None for k in (2, 3))
    each = [(r.start, r.end, r.score) for r in toxicity.offending_sentences(docs(spark, {1: text}), model).collect()]
    assert (found[1].worst_start, found[1].worst_end, found[1].worst_score) == max(each, key=lambda x: x[2])


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (4, 0), (4, 1), (99, 1)], "doc_id long, toxic int")
    df = docs(spark, EDGES)
    got = toxicity.score_documents(spark, df, labels).collect()
    assert len(got) == len(EDGES)
    assert all(r.score == 0 and r.predicted == 0 for r in got if r.doc_id in (1, 2, 3))
    assert toxicity.score_documents(spark, df.limit(0), labels).count() == 0
    assert len(toxicity.score_documents(spark, df, labels.limit(0)).collect()) == len(EDGES)


def test_kept_rows_have_all_columns(spark):
    rows = corpus()
    model = toxicity.fit([(y, t) for _, t, y in rows])
    df = docs(spark, [(i, t) for i, t, _ in rows] + [(None, None)])
    kept = toxicity.keep_clean(df, model)
    assert kept.columns == df.columns
    left = {r.doc_id for r in kept.collect()}
    assert None in left and len(left & {i for i, _, y in rows if y}) < 10 and len(left & {i for i, _, y in rows if not y}) > 290


def test_query(spark):
    """Every document of the table is scored; held-out ones are told apart well, and the score is the noisy-or of its sentences."""
    larger = DATA.replace("sf0.001", "sf0.01")
    docs_, labels = spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/labels.parquet")
    got = {r.doc_id: r for r in queries.op7_toxicity(spark, larger).collect()}
    assert len(got) == docs_.count()
    model = toxicity.train(docs_, labels, id_remainder(4) != 2)
    weights = model.table()
    texts = {r.doc_id: r.text or "" for r in docs_.collect()}
    assert all(abs(got[i].score - toxicity.noisy_or(toxicity.sentence_logits(t, weights, model.bias))) < 1e-6 for i, t in texts.items())
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(got[i].predicted, truth[i]) for i in got if got[i].held_out and truth.get(i) is not None]
    assert sum(p for p, y in held if y) >= 0.7 * sum(y for _, y in held) > 0
    assert sum(p for p, y in held if not y) <= 0.05 * sum(1 - y for _, y in held)
