"""Byte-level BPE encoding and decoding with the tiktoken library.

Ranks come from a local file.  Texts beyond ``LONG`` characters are cut before
a single space that stands between two characters that are no white space: the
pattern always starts a match there, so the parts' ids, joined, are the ids of
the whole text.  Decoding yields raw bytes and needs no valid UTF-8.

Defined results: a null text counts as empty and has no ids; repeated rows are
encoded each; other columns are not read and may have any name; an empty table gives no rows.  A token run without any safe cut is
encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

LONG = 200_000
STEP = 100_000
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def codec(rank_file: str, pattern: str):
    """The library's encoder for a local rank file (token in base64, rank)."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local_ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, long: int = LONG, step: int = STEP) -> Iterator[str]:
    """The text in order, in parts that can be encoded on their own."""
    if len(text) <= long:
        yield text
        return
    start = 0
    while start < len(text):
        cut = SAFE_CUT.search(text, start + step - 1) if start + step < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


def encode_text(enc, text: str) -> list[int]:
    ids: list[int] = []
    for part in safe_parts(text):
        ids += enc.encode_ordinary(part)
    return ids


def ids_to_bytes(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def encode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ids as an array of int."""
    def run(batches):
        enc = codec(rank_file, pattern)
        for batch in slices(batches):
            ids = [encode_text(enc, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), text_or_empty(text_col)).mapInArrow(run, f"id {kind}, ids array<int>")


def decode(df: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(id, bytes) of (id, ids): the raw bytes that the ids stand for."""
    def run(batches):
        enc = codec(rank_file, pattern)
        for batch in slices(batches):
            raw = [enc.decode_bytes(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["id", "bytes"])

    kind = df.schema["id"].dataType.simpleString()
    return df.select("id", "ids").mapInArrow(run, f"id {kind}, bytes binary")


def round_trip(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text, decode its ids again, and return counts and digests.

    One pass over the texts: ids never leave the task, only 64-byte digests do.
    """
    def run(batches):
        enc = codec(rank_file, pattern)
        for batch in slices(batches):
            counts, of_ids, of_bytes = [], [], []
            for text in batch.column(1).to_pylist():
                ids = encode_text(enc, text)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(ids_to_bytes(ids)).hexdigest())
                of_bytes.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), text_or_empty(text_col)).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
