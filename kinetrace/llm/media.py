"""Media columns: content-addressed payloads in tar shards.

A payload is padded to rows of 64 samples and stored as an 8-bit greyscale PNG
image, 64 pixels wide.  Each task appends its images to tar files in a shared
folder; a member's name is the SHA-256 of its payload, and a payload that the
task has stored already is not stored again; of copies that several tasks store,
all rows point to one (``one_member_each``).  Rows carry digest, shard, offset and length; ``media_header`` fills metadata columns by reading the first 33
bytes of a member, ``read_features`` reads members back by range.

Folders are opened with pyarrow's file systems (file, hdfs, s3, gs).  A task
writes files under names of its own, so a task that is run again leaves no rows
that point to a broken file.

Defined results: a null text counts as empty and becomes 64 zero samples; texts
of any length are stored whole; equal texts, and repeated rows, have equal values in
all columns; other columns are never read, so their names may clash with any; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_path, slices, text_or_empty

#: Samples of a row, bytes of a tar file before the next is begun, zlib's level.
WIDTH, SHARD_BYTES, LEVEL = 64, 256 << 20, 6
#: Entries of a task's tables of members, which are emptied beyond them; keys over which copies are spread.
SEEN, SALTS = 1_000_000, 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, and the header chunk with length, name, 13 bytes and checksum.
HEADER_BYTES = 33


def pad(raw: bytes, width: int = WIDTH) -> bytes:
    """Zero bytes up to a positive multiple of ``width``."""
    return raw + bytes(-len(raw) % width if raw else width)


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def to_png(payload: bytes, width: int = WIDTH) -> bytes:
    """The payload as greyscale image, each row with filter type 0."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, width)
    framed = np.zeros((len(rows), width + 1), dtype=np.uint8)
    framed[:, 1:] = rows
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(framed.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(raw: bytes) -> dict:
    """Metadata from the first ``HEADER_BYTES`` bytes."""
    if raw[:8] != SIGNATURE or raw[12:16] != b"IHDR":
        raise ValueError("no PNG header")
    width, height, depth, colour = struct.unpack(">IIBB", raw[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "colour_type": colour}


def from_png(raw: bytes) -> np.ndarray:
    """Samples of an image that ``to_png`` wrote, (height, width)."""
    width, height = (h := png_header(raw))["width"], h["height"]
    at, data = len(SIGNATURE), b""
    while at < len(raw):
        (n,) = struct.unpack(">I", raw[at : at + 4])
        body = raw[at + 8 : at + 8 + n]
        if zlib.crc32(raw[at + 4 : at + 8 + n]) != struct.unpack(">I", raw[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("broken chunk")
        if raw[at + 4 : at + 8] == b"IDAT":
            data += body
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Height, mean, deviation, share of zero samples and of distinct values, rounded."""
    counts = np.bincount(samples.ravel(), minlength=256)
    n = counts.sum()
    mean = (counts * np.arange(256)).sum() / n
    deviation = np.sqrt((counts * (np.arange(256) - mean) ** 2).sum() / n)
    return f"h={len(samples)};mean={mean:.4f};std={deviation:.4f};zero={counts[0] / n:.4f};distinct={(counts > 0).sum()}"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri)


class _TarWriter:
    """Appends members to tar files of one task; knows where a member's data lie."""

    def __init__(self, folder: str):
        self.folder, self.out, self.seen = folder, None, {}

    def put(self, payload: bytes) -> tuple[str, str, int, int]:
        digest = hashlib.sha256(payload).digest()
        if digest not in self.seen:
            if self.out is None or self.at > SHARD_BYTES:
                self.close()
                self.name = f"{self.folder}/{uuid.uuid4().hex}.tar"
                system, path = _open(self.folder)
                system.create_dir(path, recursive=True)
                self.out, self.at = system.open_output_stream(_open(self.name)[1]), 0
            media = to_png(payload)
            info = tarfile.TarInfo(f"{digest.hex()}.png")
            info.size = len(media)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            if len(self.seen) > SEEN:
                self.seen.clear()
            self.seen[digest] = self.name, self.at + len(head), len(media)
            block = head + media + bytes(-len(media) % tarfile.BLOCKSIZE)
            self.out.write(block)
            self.at += len(block)
        return digest.hex(), *self.seen[digest]

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * tarfile.BLOCKSIZE))
            self.out.close()


def store(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write payloads to tar shards; rows carry digest, shard, offset and length.

    The result is materialised: reading it again writes nothing.
    """
    def run(batches):
        tar = _TarWriter(folder)
        for batch in slices(batches):
            raw = [t.encode() for t in batch.column(1).to_pylist()]
            rows = [tar.put(pad(x)) for x in raw]
            digest, shard, offset, length = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(digest, pa.string()), pa.array(shard, pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())],
                ["doc_id", "n_bytes", "digest", "shard", "offset", "length"],
            )
        tar.close()

    kind = df.schema[id_col].dataType.simpleString()
    stored = df.select(F.col(id_col), text_or_empty(text_col)).mapInArrow(run, f"doc_id {kind}, n_bytes long, digest string, shard string, offset long, length long")
    return materialize(stored, "media-rows")


class _RangeReader:
    """Reads byte ranges; keeps one file open."""

    def __init__(self):
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            system, path = _open(name)
            self.name, self.file = name, system.open_input_file(path)
        return self.file.read_at(length, offset)


def media_header(rows: DataFrame) -> DataFrame:
    """Add width, height, bit_depth from header-only range reads."""
    def run(batches):
        reader = _RangeReader()
        for batch in slices(batches):
            names, offsets = batch.column("shard").to_pylist(), batch.column("offset").to_pylist()
            heads = [png_header(reader.read(n, o, HEADER_BYTES)) for n, o in zip(names, offsets, strict=True)]
            more = [pa.array([h[k] for h in heads], pa.int32()) for k in ("width", "height", "bit_depth")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "width", "height", "bit_depth"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{schema}, width int, height int, bit_depth int")


def one_member_each(rows: DataFrame) -> DataFrame:
    """Rows of equal digest point to one member, whichever tasks have stored it; the others are left unread.

    Only pointers move.  Rows of a digest meet as partial minima of SALTS keys.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(SALTS)))
    parts = materialize(salted, "pointers")
    at = F.min(F.struct("shard", "offset")).alias("at")
    partial = parts.groupBy("digest", "salt").agg(at)
    routed = partial.select("digest", "salt").join(partial.groupBy("digest").agg(F.min("at").alias("at")), "digest")
    return parts.drop("shard", "offset").join(routed, ["digest", "salt"]).select("doc_id", "n_bytes", "digest", "at.shard", "at.offset", "length")


def read_features(rows: DataFrame) -> DataFrame:
    """Read members back by range and add payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def run(batches):
        reader, seen = _RangeReader(), {}
        for batch in slices(batches):
            found = []
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if (values := seen.get((name, offset))) is None:
                    media = reader.read(name, offset, length)
                    samples = from_png(media)
                    payload = samples.tobytes()
                    values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples))
                    if len(seen) > SEEN:
                        seen.clear()
                    seen[name, offset] = values
                found.append(values)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            columns = [pa.array([v[i] for v in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    more = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rows.mapInArrow(run, f"{schema}, {more}")


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Store all texts as media; fill width, height and depth from headers alone, the rest from whole members.

    Rows are sorted by place in the shards, so a task opens each file once.
    """
    stored = store(df, folder or scratch_path(df.sparkSession, "media"), id_col, text_col)
    placed = one_member_each(stored).sortWithinPartitions("shard", "offset")
    return read_features(materialize(media_header(placed), "media-headers"))
