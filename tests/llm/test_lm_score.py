import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import duck_rows, spark_rows
from conftest import DATA
from helpers import EDGES, docs

from kinetrace.llm import lm_score, queries


def tokenize(text):
    return text.encode().lower().split()


class Plain:
    """The automaton of texts in memory, arc by arc."""

    def __init__(self, texts, strengths):
        self.memory, self.strengths, counts = len(strengths), strengths, Counter()
        for text in texts:
            sequence = [None, *tokenize(text), b"\n"]  # the end is no word
            for i in range(1, len(sequence)):
                for n in range(1, min(self.memory + 1, i + 1) + 1):
                    counts[tuple(sequence[i - n + 1 : i + 1])] += 1
        self.tokens = sum(c for g, c in counts.items() if len(g) == 1)
        self.known = {g[0]: c for g, c in counts.items() if len(g) == 1}
        context = Counter()
        for gram, c in counts.items():
            if len(gram) > 1:
                context[gram[:-1]] += c
        self.failure = {h: math.log10(strengths[len(h) - 1] / (c + strengths[len(h) - 1])) for h, c in context.items()}
        self.arcs = defaultdict(dict)
        for gram in sorted(counts, key=len):
            h, w = gram[:-1], gram[-1]
            if h:
                k = strengths[len(h) - 1]
                p = (counts[gram] + k * 10 ** self.weight(h[1:], w)) / (context[h] + k)
            else:
                p = (counts[gram] + 1) / (self.tokens + len(self.known) + 1)
            self.arcs[h][w] = math.log10(p)

    def weight(self, state, token):
        total = 0.0
        while token not in self.arcs.get(state, ()):
            if not state:
                return total - math.log10(self.tokens + len(self.known) + 1)
            total += self.failure.get(state, 0.0)
            state = state[1:]
        return total + self.arcs[state][token]

    def score(self, text):
        state, total = (None,)[: self.memory], 0.0
        for token in [*tokenize(text), b"\n"]:
            total += self.weight(state, token)
            state = (*state, token)[-self.memory :] if self.memory else ()
        return total


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


@pytest.mark.parametrize("strengths", [(), (7.0,), (7.0, 3.0), (9.0, 5.0, 2.0)])
@pytest.mark.parametrize("block_bytes, fan_bits", [(400, 1), (1 << 20, 13)])
def test_blocks_score_as_the_automaton(spark, strengths, block_bytes, fan_bits):
    """With one bit a level, requests of the small blocks climb many levels."""
    texts = [*EDGES, *((40 + i, f"Same words come again {i % 4} and same words stay") for i in range(40))]
    model = Plain([t or "" for i, t in texts if not held_out(i)], strengths)
    table = docs(spark, texts)
    if block_bytes == 400:  # few levels: the long text alone is many blocks' bytes
        texts = [(i, t) for i, t in texts if i != 7]
        table, model = docs(spark, texts), Plain([t or "" for i, t in texts if not held_out(i)], strengths)
    got = lm_score.score_documents(table, strengths=strengths, block_bytes=block_bytes, fan_bits=fan_bits).collect()
    assert len(got) == len(texts)
    want = sorted((str(i), held_out(i), model.score(t or "")) for i, t in texts)
    for r, (i, out, s) in zip(sorted(got, key=lambda r: (str(r.doc_id), r.held_out, r.score)), want, strict=True):
        assert str(r.doc_id) == i and r.held_out == out and r.score == pytest.approx(s, rel=1e-9, abs=1e-9)


def test_pieces_do_not_change_scores():
    import pyarrow as pa

    grams = lm_score.BlockGrams(pa.array(["a b c a b d " * 50, "", "b"]), 3)
    totals = grams.by_length(grams.counts(np.array([True, True, False])))
    model = lm_score.BlockAutomaton(grams, totals, int((totals[0] > 0).sum()), int(totals[0].sum()), (5.0, 2.0))
    for piece in (2, 3, 64):
        assert model.scores(piece) == pytest.approx(model.scores(1000))


def test_whole_table(spark):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    train = [[*tokenize(t), None] for i, t in table if not held_out(i)]
    model = Plain([t for i, t in table if not held_out(i)], lm_score.STRENGTHS)
    counts = Counter(w for tokens in train for w in tokens)
    total, places = sum(counts.values()), sum(counts.values()) + len(counts) + 1
    rows = {r.doc_id: r for r in queries.op1_lm_score(spark, DATA).collect()}
    for i, t in table:
        tokens = [*tokenize(t), None]
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(w in counts for w in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts.get(w, 0) + 1) / places) for w in tokens), abs=1e-6)
        assert r.score == pytest.approx(model.score(t), abs=1e-6)
    out = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_against_sql(spark, duck):
    df = queries.op1_lm_score(spark, DATA)
    names, want = duck_rows(duck, queries.oracle_sql()["op1_lm_score"])
    assert sorted(df.columns) == names
    for a, b in zip(spark_rows(df), want, strict=True):
        assert a == pytest.approx(b, abs=2e-6)


def test_probabilities_add_up():
    model = Plain(["a b a c", "b a"], (3.0,))
    for state in [(None,), (b"a",), (b"unseen",)]:
        known = sum(10 ** model.weight(state, w) for w in model.known)
        assert known + 10 ** model.weight(state, b"never") == pytest.approx(1)


def test_request_rows_grow_with_the_blocks(spark):
    """Each block sends 2^fan_bits rows at most, however many blocks there are."""
    for n in (40, 80):
        table = docs(spark, [(i, f"w{i} w{i + 1} w{i + 2} " * 20) for i in range(n)])
        rows = table.select("doc_id", (table.doc_id < 0).alias("held_out"), "text")
        asked = lm_score.requests(rows, 1000, 3, lm_score._bits(n, 2))
        assert asked.count() == 4 * lm_score.pack_blocks(rows, 1000).count()


def test_a_block_takes_few_bytes_for_an_n_gram():
    """A worker holds a block's n-grams and its automaton at once; two workers share an executor."""
    import random
    import tracemalloc

    import pyarrow as pa

    chosen, words = random.Random(3), [f"w{i}" for i in range(20_000)]
    texts = pa.array([" ".join(chosen.choices(words, k=300)) for _ in range(300)])
    tracemalloc.start()
    try:
        grams = lm_score.BlockGrams(texts, 3)
        n, (_, building) = len(grams.keys), tracemalloc.get_traced_memory()
        tracemalloc.reset_peak()
        totals = grams.by_length(grams.counts(np.ones(300, bool)))
        grams.forget_keys()
        lm_score.BlockAutomaton(grams, totals, 10, 10, (2000.0, 20.0))
        _, both = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert building < 65 * n and both < 110 * n


def test_empty_table(spark):
    assert lm_score.score_documents(docs(spark, EDGES).limit(0)).count() == 0


def test_numbers_pack():
    counts = np.array([0, 1, 254, 255, 256, 10**12], dtype=np.uint64)
    assert (lm_score.unpack_counts(lm_score.pack_counts(counts), 6) == counts).all()
    keys = np.random.default_rng(1).integers(1 << 64, size=1000, dtype=np.uint64)
    keys = keys[lm_score.in_order(keys)]
    for some in (keys, keys[:1], keys[:0]):
        assert (lm_score.unpack_keys(lm_score.pack_keys(some)) == some).all()
