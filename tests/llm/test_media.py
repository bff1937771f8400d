import hashlib
import tarfile
import zlib

import numpy as np
from conftest import DATA
from helpers import EDGES, docs

from kinetrace.llm import media, queries


def check(row, text):
    raw = (text or "").encode()
    payload = raw + bytes(-len(raw) % 64 if raw else 64)
    assert row.n_bytes == len(raw) and row.payload_bytes == len(payload)
    assert row.payload_sha256 == hashlib.sha256(payload).hexdigest() and row.tail_crc32 == zlib.crc32(payload[-64:])


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.op10_media_columns(spark, DATA).collect()
    assert len(got) == len(texts)
    same = {}
    for r in got:
        check(r, texts[r.doc_id])
        assert same.setdefault(texts[r.doc_id], r[3:]) == r[3:]


def test_edges_and_tar_files(spark, tmp_path):
    df = docs(spark, EDGES).repartition(3)
    folder = f"file://{tmp_path}/shards"
    rows = media.store(df, folder).cache()
    by_id = {}
    for i, t in EDGES:
        by_id.setdefault(i, t)
    features = media.read_features(rows).collect()
    assert len(features) == len(EDGES)
    for r in features:
        check(r, by_id[r.doc_id])
    heads = media.media_header(rows).collect()
    assert all(h.width == 64 and h.bit_depth == 8 for h in heads)
    for r in rows.collect():
        with tarfile.open(r.shard.removeprefix("file://")) as tar:
            member = tar.getmember(f"{r.digest}.png")
            assert (member.offset_data, member.size) == (r.offset, r.length)
            assert hashlib.sha256(media.from_png(tar.extractfile(member).read()).tobytes()).hexdigest() == r.digest
    assert media.media_columns(df.limit(0)).count() == 0


def test_copies_are_stored_once_a_task(spark, tmp_path):
    rows = media.store(docs(spark, [(i, "copy") for i in range(50)]).coalesce(1), f"file://{tmp_path}/s")
    assert rows.select("shard", "offset").distinct().count() == 1


def test_image_round_trip():
    payload = np.random.default_rng(0).integers(0, 256, 64 * 7, dtype=np.uint8).tobytes()
    assert media.from_png(media.to_png(payload)).tobytes() == payload


def test_copies_of_all_tasks_share_a_member(spark):
    df = docs(spark, [(i, "copy" if i % 3 else f"own {i}") for i in range(60)]).repartition(4)
    got = media.media_columns(df).collect()
    assert len(got) == 60 and len({(r.shard, r.offset, r.digest) for r in got}) == 21
    assert all((r.width, r.height) == (64, r.payload_bytes // 64) for r in got)
