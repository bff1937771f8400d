"""Packing along a space-filling curve.

Each document's token ids are hashed to a vector, projected to few dimensions
and mapped to its place on a Hilbert curve.  Documents are range-sorted by that
place and their tokens laid end to end along the curve, so a sequence holds
neighbours; sequences are cut every ``length`` tokens, and only the very last
one can be short.

Defined results: a null text counts as empty and gives the separator alone, as
does an empty one; documents of any length are cut into as many pieces as they
need; equal vectors are told apart by row, so a text with very many copies
spreads over tasks; repeated rows are packed each; an empty table gives no
rows; other columns are not read and may have any name.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, text_or_empty
from .bpe_codec import safe_parts
from .pieces import fast_encoder, id_type

#: Buckets of the hashed vector, dimensions after projection, bits of a dimension.
HASHED, DIMS, BITS = 256, 3, 10


def projection(seed: int = 17) -> np.ndarray:
    """A fixed Gaussian projection from hashed buckets to a few dimensions."""
    return np.random.default_rng(seed).standard_normal((HASHED, DIMS))


def project(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The document's point: its hashed bag of tokens, unit length, projected."""
    if not len(ids):
        return np.zeros(DIMS)
    bucket = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
    bag = np.sqrt(np.bincount(bucket.astype(np.int64), minlength=HASHED).astype(float))
    return (bag / np.linalg.norm(bag)) @ table


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n, dims) with ``bits`` bits each.

    Undo the rotations from the highest bit to the lowest, take the Gray code,
    then interleave the bits.
    """
    x = cells.astype(np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def encode_documents(df: DataFrame, tokenizer_file: str, pattern: str, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, n_tokens, ids) of each document; ids are bytes, two or four per id."""
    def run(batches):
        encode, kind, table = fast_encoder(tokenizer_file, pattern), id_type(tokenizer_file), projection()
        for batch in slices(batches):
            ids = [np.concatenate([*map(encode, safe_parts(t)), [separator]]).astype(kind) for t in batch.column(1).to_pylist()]
            points = np.array([project(x[:-1], table) for x in ids]).reshape(-1, DIMS)
            cells = np.clip((points / 4 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hilbert_key(cells), pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                ["doc_id", "key", "n_tokens", "ids"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), text_or_empty(text_col)).mapInArrow(run, f"doc_id {kind}, key long, n_tokens long, ids binary")


def curve_positions(coded: DataFrame) -> DataFrame:
    """(row_no, first): the tokens before each document along the curve.

    Range-sorting moves three numbers a document.  Sums of whole ranges, one
    number per range, give where each range begins.
    """
    spark = coded.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "row_no"]
    sorted_rows = coded.select("key", "row_no", "n_tokens").repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
    placed = materialize(sorted_rows, "curve")
    # One row per range; their running sum is over as many rows as there are ranges.
    whole = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = placed.groupBy("range").agg(F.sum("n_tokens").alias("n")).select("range", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(F.broadcast(begins), "range")
        .select("row_no", (F.col("begin") + F.col("before")).alias("first"))
    )


def pack(df: DataFrame, tokenizer_file: str, pattern: str, length: int = 1024, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents, in sequences of ``length`` tokens.

    doc_id, start (the document's ids before the piece), length, ids_crc32,
    doc_tokens, sequence_id, offset, token_ids (bytes, little-endian, unsigned,
    two per id for vocabularies up to 65,536, else four).
    """
    coded = materialize(encode_documents(df, tokenizer_file, pattern, separator, id_col, text_col).withColumn("row_no", F.monotonically_increasing_id()), "token-ids")
    kind = id_type(tokenizer_file)
    placed = coded.select("row_no", "doc_id", "ids").join(curve_positions(coded), "row_no").select("doc_id", "first", "ids")

    def cut(batches):
        for batch in slices(batches):
            columns: list[list] = [[] for _ in range(7)]
            rows: list[int] = []
            for row, (first, raw) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                ids = np.frombuffer(raw, dtype=kind)
                at = 0
                while at < len(ids):
                    sequence, offset = divmod(first + at, length)
                    piece = ids[at : at + length - offset]
                    values = (at, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), len(ids), sequence, offset, piece.tobytes())
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
                    rows.append(row)
                    at += len(piece)
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "token_ids"])

    id_kind = df.schema[id_col].dataType.simpleString()
    return placed.mapInArrow(cut, f"doc_id {id_kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, token_ids binary")
