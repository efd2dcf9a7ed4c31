"""Media columns: content-addressed payloads in tar shards.

A payload is stored losslessly as an 8-bit grey PNG of 64 columns: a text's UTF-8 bytes, padded with
zeros to a positive multiple of 64, one sample a byte. Tasks append the media to tar shards in the
shared folder; a member's name is the SHA-256 of the media, and a shard holds each digest once, so a
group of copies costs one member for each shard and no shuffle. Rows carry shard, digest, offset and
length. A shard gets its final name when it is complete; a task that is run again writes shards of its
own, and rows only name shards of the attempt that delivered them.

`read_headers` fills metadata columns from range reads of the first 33 bytes of each medium;
`read_media` reads the whole ranges and computes features of the samples.

Defined results: a null text counts as empty (64 zero bytes); equal texts have equal values; long texts
are stored whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.llm import common

COLUMNS = 64
#: Bytes after which a task begins a new shard.
SHARD_BYTES = 256 << 20
#: Bytes of a shard that one task reads back.
READ_BYTES = 8 << 20
#: Signature, and the header chunk with its length and checksum.
HEADER_BYTES = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 6


def payload_of(body: bytes) -> bytes:
    return body + bytes(-len(body) % COLUMNS or (0 if body else COLUMNS))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image with `COLUMNS` samples a row; rows are stored unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, COLUMNS)
    raw = np.zeros((len(rows), COLUMNS + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", COLUMNS, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def header_of(media: bytes) -> tuple[int, int, int]:
    """(width, height, bits a sample) of a PNG's first bytes."""
    if media[:8] != SIGNATURE or media[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", media[16:25])


def from_png(media: bytes) -> bytes:
    width, height, _ = header_of(media)
    at, data = 8, []
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return raw[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean sample, and an 8 x 8 average hash: cells of the image above the mean."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, COLUMNS)
    edges = [len(rows) * k // 8 for k in range(9)]
    cells = np.array([rows[a : max(b, a + 1)].reshape(-1, 8, 8).mean(axis=(0, 2)) if a < len(rows) else np.zeros(8) for a, b in zip(edges, edges[1:])])
    bits = np.packbits(cells.ravel() > cells.mean())
    return f"mean={rows.mean():.4f};ahash={bits.tobytes().hex()}"


INDEX = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def _store(root: str):
    fields = ["doc_id", "n_bytes", "digest", "shard", "offset", "length"]

    def run(batches):
        fs, base = common.open_fs(root)
        fs.create_dir(base, recursive=True)
        out, name, at, held = None, "", 0, {}

        def close():
            out.write(bytes(2 * tarfile.BLOCKSIZE))
            out.close()
            fs.move(f"{base}/{name}.part", f"{base}/{name}")

        for batch in batches:
            for part in common.pieces_of(batch):
                rows = []
                for doc_id, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if out is None or at > SHARD_BYTES:
                        if out is not None:
                            close()
                        name, at, held = f"{uuid.uuid4().hex}.tar", 0, {}
                        out = fs.open_output_stream(f"{base}/{name}.part")
                    key = hashlib.sha256(body).digest()
                    if key not in held:
                        media = to_png(payload_of(body))
                        digest = hashlib.sha256(media).hexdigest()
                        info = tarfile.TarInfo(f"{digest}.png")
                        info.size = len(media)
                        head = info.tobuf(tarfile.USTAR_FORMAT)
                        out.write(head)
                        out.write(media)
                        out.write(bytes(-len(media) % tarfile.BLOCKSIZE))
                        held[key] = (digest, at + len(head), len(media))
                        at += len(head) + len(media) + -len(media) % tarfile.BLOCKSIZE
                    rows.append((doc_id, len(body), held[key][0], name, *held[key][1:]))
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=fields)
        if out is not None:
            close()

    return run


def store(docs: DataFrame, root: str) -> DataFrame:
    """Write all texts as media; returns the settled index, one row for each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.bytes_of().alias("body"))
    return common.settle(common.arrow_map(rows, _store(root), INDEX), "media-index")


def dealt(index: DataFrame) -> DataFrame:
    """index in parts of READ_BYTES of a shard, in the order of the shard; rows that share a medium stand together."""
    stretch = F.floor(F.col("offset") / F.lit(READ_BYTES))
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.repartition(n, "shard", stretch).sortWithinPartitions("shard", "offset")


def _ranges(root: str, what, least: int | None):
    """Calls what(bytes) once for each range and shard of the rows, and appends its values to the rows."""

    def run(batches):
        fs, base = common.open_fs(root)
        name, file, known = None, None, {}
        for batch in batches:
            got = []
            for shard, offset, length in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), batch.column("length").to_pylist()):
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file, known = shard, fs.open_input_file(f"{base}/{shard}"), {}
                if offset not in known:
                    known[offset] = what(file.read_at(min(length, least or length), offset))
                got.append(known[offset])
            columns = [pa.array(list(c)) for c in zip(*got)] if got else []
            if columns:
                yield pa.record_batch([*batch.columns, *columns], names=[*batch.schema.names, *[f"c{k}" for k in range(len(columns))]])
        if file is not None:
            file.close()

    return run


def read_headers(index: DataFrame, root: str) -> DataFrame:
    """index with width, height and bits a sample, from the first bytes of each medium only."""
    out = common.arrow_map(index, _ranges(root, header_of, HEADER_BYTES), _schema(index) + ", width long, height long, sample_bits long")
    return out


def _measure(media: bytes) -> tuple:
    payload = from_png(media)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)


def read_media(index: DataFrame, root: str) -> DataFrame:
    """index with what the stored bytes hold: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    more = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return common.arrow_map(index, _ranges(root, _measure, None), f"{_schema(index)}, {more}")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = common.new_path(spark, "media")
    index = dealt(store(common.docs_of(spark, sf_dir), root))
    out = read_media(read_headers(index, root), root)
    # shard and offset say where a row's copy is, which differs between copies of a text
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "sample_bits")
