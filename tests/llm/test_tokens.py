"""Encoding, counting and packing against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import DATA
from helpers import EDGES, docs

from kinetrace.llm import bpe_codec, packing, queries, token_counts
from kinetrace.llm.pieces import fast_encoder, tokenizer
from kinetrace.llm.queries import PATTERN, RANKS, TOKENIZER

SNIPPETS = ["a", "the", " ", "  ", "\n", " \n", "'re", "'", "l", "don't", "é", "漢", "1", "23", "<|endoftext|>", "<|", "!", "\t", "\x1c", " he", "　", "re", "ve"]


def library_ids(text):
    return tokenizer(TOKENIZER).encode(text or "", add_special_tokens=False).ids


def table(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def test_codec_round_trip(spark):
    enc = bpe_codec.codec(RANKS, PATTERN)
    want = {i: t for i, t in table(spark)}
    for r in queries.op4_bpe_codec(spark, DATA).collect():
        ids = enc.encode_ordinary(want[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()


def test_codec_edges(spark):
    df = docs(spark, EDGES)
    got = bpe_codec.round_trip(df, RANKS, PATTERN).collect()
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in EDGES)
    back = bpe_codec.decode(bpe_codec.encode(df, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert sorted(bytes(r.bytes) for r in back) == sorted((t or "").encode() for _, t in EDGES)
    assert bpe_codec.round_trip(df.limit(0), RANKS, PATTERN).count() == 0


def test_safe_parts_leave_ids_unchanged():
    enc, rng = bpe_codec.codec(RANKS, PATTERN), random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(SNIPPETS) for _ in range(60))
        parts = list(bpe_codec.safe_parts(text, long=20, step=15))
        assert "".join(parts) == text
        assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_fast_encoder_is_the_library():
    encode, rng = fast_encoder(TOKENIZER, PATTERN), random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(SNIPPETS) for _ in range(rng.randrange(14)))
        assert encode(text).tolist() == library_ids(text), repr(text)


def test_counts_of_every_prefix():
    counter, rng = token_counts.prefix_counts(TOKENIZER, PATTERN), random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(SNIPPETS) for _ in range(rng.randrange(12)))
        assert counter.counts(text).tolist() == [len(library_ids(text[:i])) for i in range(len(text) + 1)], repr(text)


def test_token_counts(spark):
    want = {i: t for i, t in table(spark)}
    for r in queries.op8_token_counts(spark, DATA).collect():
        n = len(library_ids(want[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(want[r.doc_id].encode()), n > 1024)
        kept = want[r.doc_id].encode()[: r.keep_bytes].decode()
        assert len(library_ids(kept)) <= 1024 and (n > 1024 or r.keep_bytes == r.n_bytes)


def test_bytes_within_a_limit():
    """The longest prefix by encoding every prefix with the library."""
    parts, counter, rng = token_counts.part_totals(TOKENIZER, PATTERN), token_counts.prefix_counts(TOKENIZER, PATTERN), random.Random(8)
    seen = 0
    for _ in range(300):
        text = "".join(rng.choice(SNIPPETS) for _ in range(rng.randrange(1, 14)))
        limit = rng.randrange(0, 12)
        head, rest, totals = parts.parts_of(text)
        if sum(totals) > limit:
            want = max(i for i in range(len(text) + 1) if len(library_ids(text[:i])) <= limit)
            assert token_counts.bytes_within(head, rest, totals, limit, counter) == len(text[:want].encode()), (text, limit)
            seen += 1
    assert seen > 100


def test_token_count_edges(spark):
    df = docs(spark, EDGES)
    got = sorted((str(r.doc_id), r.n_tokens) for r in token_counts.token_counts(df, TOKENIZER, PATTERN).collect())
    assert got == sorted((str(i), len(library_ids(t))) for i, t in EDGES)
    assert token_counts.token_counts(df.limit(0), TOKENIZER, PATTERN).count() == 0


def test_long_matches_take_the_same_steps():
    """Matches far beyond the remembered length, by prefixes too, against the library."""
    counts = token_counts.prefix_counts(TOKENIZER, PATTERN)
    rng = np.random.default_rng(5)
    runs = ["a" * 3000, "the" * 1000, "é" * 900, "".join(rng.choice(list("abcdefghij"), 4000)), "-=" * 1500, "7" * 2500]
    for run in runs:
        assert counts.total(run) == len(library_ids(run))
        got = counts.counts(run[:400])
        assert [int(got[i]) for i in range(0, 401, 23)] == [len(library_ids(run[:i])) for i in range(0, 401, 23)]


def test_budgets_from_stored_counts(spark):
    stored = token_counts.prefix_table(docs(spark, [(1, "hello there world"), (2, "")]), TOKENIZER, PATTERN)
    got = {r.doc_id: r.keep_chars for r in token_counts.fits(stored, 2).collect()}
    assert got == {1: 11, 2: 0}
    assert token_counts.prefix_counts(TOKENIZER, PATTERN).truncate("hello there world", 2) == "hello there"


def check_packing(got, texts, length=1024):
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    want = {i: [*library_ids(t), 0] for i, t in texts}
    assert set(pieces) == set(want)
    for i, rows in pieces.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            ids = np.array(want[i][at : at + r.length], "<u4")
            assert r.start == at and r.doc_tokens == len(want[i]) and r.ids_crc32 == zlib.crc32(ids.tobytes())
            at += r.length
        assert at == len(want[i])
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, spans in sequences.items():
        ends = 0
        for offset, n in sorted(spans):
            assert offset == ends
            ends += n
        assert ends == length or k == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))


def test_packing(spark):
    check_packing(queries.op5_packing(spark, DATA).collect(), table(spark))


def test_packing_edges(spark):
    unique = [(k, t) for k, (_, t) in enumerate(EDGES)]
    check_packing(packing.pack(docs(spark, unique), TOKENIZER, PATTERN, length=64).collect(), unique, 64)
    assert packing.pack(docs(spark, EDGES).limit(0), TOKENIZER, PATTERN).count() == 0


@pytest.mark.parametrize("dims", [2, 3])
def test_hilbert_curve_visits_neighbours(dims):
    side = 8
    cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    keys = packing.hilbert_key(cells, bits=3)
    assert sorted(keys) == list(range(side**dims))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
