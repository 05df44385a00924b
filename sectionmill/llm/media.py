"""Media columns: content-addressed payloads in tar shards.

Every payload becomes a grey 8-bit image, ``WIDTH`` samples wide, and is named by the digest of
its samples in a tar shard of the shared folder. Equal payloads are stored once in the whole store: the digests that
occur more than once are found first, and their payloads meet by digest before one task writes them. Rows carry digest,
shard, offset and length. Metadata columns come from range reads of an image's first bytes alone; features
from the whole image, once for each digest. A shard has a name of its own for each attempt of a task, so a task that runs
again after a lost executor leaves rows that point to complete files only.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import bound_batches, materialise, new_path

WIDTH, SHARD_BYTES, CHUNK_BYTES = 192, 256 << 20, 16 << 20
#: Digests of repeated payloads that are broadcast at most (about 25 MB); if there are more, all payloads meet by digest.
MOST_BROADCAST = 200_000
_SIGN = b"\x89PNG\r\n\x1a\n"
#: Bytes that hold the signature and the header chunk.
HEADER_BYTES = 33
#: Names of object stores in Hadoop, and in Arrow.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def raw_bytes(text: Column) -> Column:
    """A text's bytes as they are, valid UTF-8 or not; none if it is null."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def payload_of(text: Column) -> Column:
    """The bytes filled up with blanks to a positive multiple of ``WIDTH``."""
    n = F.octet_length(raw_bytes(text))
    blanks = F.when(n == 0, WIDTH).otherwise(F.pmod(-n, F.lit(WIDTH)))
    return F.concat(raw_bytes(text), F.repeat(F.lit(" "), blanks).cast("binary"))


def open_store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's uri, and its path there. Hadoop's names of object stores
    are understood; what Arrow has no client for raises."""
    scheme, colon, rest = folder.partition("://")
    return pafs.FileSystem.from_uri(_SCHEMES.get(scheme, scheme) + colon + rest)


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def encode(payload: bytes) -> bytes:
    """A grey PNG whose samples are the payload."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0))
    return _SIGN + head + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def header(start: bytes) -> tuple[int, int]:
    """(width, height) from an image's first ``HEADER_BYTES``."""
    if start[:8] != _SIGN or start[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    return struct.unpack(">II", start[16:24])


def decode(media: bytes) -> np.ndarray:
    """The samples of an image, (height, width)."""
    width, height = header(media)
    at, packed = 33, []
    while at < len(media):
        n, name = struct.unpack(">I4s", media[at : at + 8])
        if name == b"IDAT":
            packed.append(media[at + 8 : at + 8 + n])
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    return np.ascontiguousarray(lines[:, 1:])


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit difference hash of the image."""
    counts = np.bincount(samples.reshape(-1), minlength=256)
    n, level = counts.sum(), np.arange(256)
    mean = float((counts * level).sum() / n)
    deviation = float(np.sqrt(max(0.0, (counts * level * level).sum() / n - mean * mean)))
    p = counts[counts > 0] / n
    entropy = float(-(p * np.log2(p)).sum())
    h = len(samples)
    edges = np.arange(8) * h // 8
    columns = np.add.reduceat(samples.astype(np.int64), np.arange(9) * WIDTH // 9, axis=1)
    cells = np.array([columns[a : max(a + 1, b)].sum(axis=0) for a, b in zip(edges, [*edges[1:], h], strict=True)])
    widths = np.diff(np.append(np.arange(9) * WIDTH // 9, WIDTH))
    bits = (cells[:, 1:] * widths[:-1] > cells[:, :-1] * widths[1:]).reshape(-1)
    return f"{mean:.4f}:{deviation:.4f}:{entropy:.4f}:{np.packbits(bits).tobytes().hex()}"


def _writer(folder: str, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        out = name = None
        at = 0
        try:
            for batch in batches:
                names, offsets, lengths = [], [], []
                for digest, payload in zip(batch.column("digest").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                    if out is not None and at >= shard_bytes:
                        out.write(bytes(1024))
                        out.close()
                        out = None
                    if out is None:
                        name, at = f"{uuid.uuid4().hex}.tar", 0
                        out = store.open_output_stream(f"{root}/{name}")
                    media = encode(payload)
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(media)
                    front = info.tobuf(tarfile.GNU_FORMAT)
                    out.write(front + media + bytes(-len(media) % 512))
                    names.append(name)
                    offsets.append(at + len(front))
                    lengths.append(len(media))
                    at += len(front) + len(media) + (-len(media) % 512)
                yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["digest", "shard", "offset", "length"])
            if out is not None:
                out.write(bytes(1024))
        finally:
            if out is not None:
                out.close()

    return run


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", *, shard_bytes: int = SHARD_BYTES, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Write the payloads into shards in ``folder`` (a uri of a shared file system) and return the
    references (id, digest, n_bytes, shard, offset, length), one row per row of ``docs``.

    A payload is stored once, however many rows have it. A null text is an empty one; a text of broken
    UTF-8 is stored byte by byte; a very long one is one image. Ids may be of any type, null and repeated: each row has its reference.
    An empty table gives no rows and no shards. Columns other than the two named aren't read.
    """
    bound_batches(docs.sparkSession)
    text = F.col(text_col)
    named = materialise(docs.select(F.col(id_col).alias("id"), F.sha2(payload_of(text), 256).alias("digest"), F.octet_length(raw_bytes(text)).cast("long").alias("n_bytes")), "digests")
    again = materialise(named.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "repeated")
    payloads = docs.select(payload_of(text).alias("payload")).select(F.sha2("payload", 256).alias("digest"), "payload")
    first = lambda df: df.groupBy("digest").agg(F.first("payload").alias("payload"))
    if again.count() <= most_broadcast:
        few = F.broadcast(again)
        payloads = payloads.join(few, "digest", "left_anti").unionByName(first(payloads.join(few, "digest", "left_semi")))
    else:
        payloads = first(payloads)
    stored = materialise(payloads.mapInArrow(_writer(folder, shard_bytes), "digest string, shard string, offset long, length long"), "stored")
    return named.join(stored, "digest").select("id", "digest", "n_bytes", "shard", "offset", "length")


_WHOLE = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_sha256": "string", "feature": "string", "intact": "boolean"}
_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _reader(folder: str, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_store(folder)
        file = opened = None
        try:
            for batch in batches:
                rows = []
                for digest, shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True):
                    if shard != opened:
                        if file is not None:
                            file.close()
                        file, opened = files.open_input_file(f"{root}/{shard}"), shard
                    width, height = header(bytes(file.read_at(HEADER_BYTES, offset)))
                    got = {"width": width, "height": height}
                    if whole:
                        media = bytes(file.read_at(length, offset))
                        samples = decode(media)
                        payload = samples.tobytes()
                        sha = hashlib.sha256(payload).hexdigest()
                        got |= {
                            "payload_bytes": len(payload), "payload_sha256": sha, "tail_crc32": zlib.crc32(payload[-16:]),
                            "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature(samples), "intact": sha == digest,
                        }
                    rows.append(got)
                names = {"width": "long", "height": "long"} | (_WHOLE if whole else {})
                cols = [pa.array([r[c] for r in rows], _ARROW[t]) for c, t in names.items()]
                yield pa.RecordBatch.from_arrays([batch.column("digest"), *cols], names=["digest", *names])
        finally:
            if file is not None:
                file.close()

    return run


def _read(references: DataFrame, folder: str, whole: bool) -> DataFrame:
    """Each stored image is read once, in the order of its shard, and its columns go to all rows with its digest."""
    bound_batches(references.sparkSession)
    stored = references.select("digest", "shard", "offset", "length").distinct()
    stored = stored.repartition("shard", F.floor(F.col("offset") / CHUNK_BYTES)).sortWithinPartitions("shard", "offset")
    names = {"width": "long", "height": "long"} | (_WHOLE if whole else {})
    found = stored.mapInArrow(_reader(folder, whole), ", ".join(["digest string", *(f"{c} {t}" for c, t in names.items())]))
    return references.select("id", "digest", "n_bytes", "length").join(found, "digest").select("id", "digest", "n_bytes", "length", *names)


def headers(references: DataFrame, folder: str) -> DataFrame:
    """Metadata columns (width, height) from header-only range reads."""
    return _read(references, folder, False)


def features(references: DataFrame, folder: str) -> DataFrame:
    """Metadata columns and what is computed from the stored bytes, read back; ``intact`` tells whether
    the samples have the digest that names them."""
    return _read(references, folder, True)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store and read back in a new folder of the shared one; (id, digest, metadata, features).

    Nulls, broken UTF-8, repeated rows, ids and empty tables are as in :func:`store`; equal texts have equal values.
    """
    folder = new_path(docs.sparkSession, "media")
    references = materialise(store(docs, folder, id_col, text_col), "references")
    return features(references, folder).withColumnRenamed("id", id_col).withColumnRenamed("length", "media_bytes")
