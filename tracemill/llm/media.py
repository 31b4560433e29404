"""Media columns: content-addressed payloads in tar shards.

A payload becomes a lossless 8-bit grey PNG (one byte a sample, `WIDTH` samples a row), named by the sha256 of its bytes.
Each task writes the pictures of its rows, each content once, to a tar file in the shared folder. Then one of a content's
places becomes its address in a shuffle of the index alone, and all rows of the content carry it: digest, shard, offset
and length. Metadata columns (width, height, bits) come from a range read of the picture's header alone; reading
payloads back is a range read of the picture, once a content, in tasks of about equal bytes. Shard names are new for each
attempt of a task and only the ones in the written index count, so a lost executor leaves at most an unused file.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import file_system

WIDTH = 576
SHARD_BYTES = 256 << 20
#: Bytes of pictures that one task reads back.
TASK_BYTES = 8 << 20
HEADER = 33  # signature and IHDR chunk
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(text: str) -> bytes:
    """UTF-8 and then bytes 255 up to a positive multiple of WIDTH; UTF-8 has no byte 255, so the length can be told."""
    data = text.encode()
    return data + b"\xff" * (WIDTH - len(data) if not data else -len(data) % WIDTH)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def picture(payload: bytes, level: int = 6) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # a leading 0: the row isn't filtered
    lines[:, 1:] = rows
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def samples(stored: bytes) -> bytes:
    """The payload of a stored picture; checksums are checked."""
    if stored[:8] != SIGNATURE:
        raise ValueError("not a picture")
    at, data, width = 8, [], 0
    while at < len(stored):
        n, kind = struct.unpack_from(">I4s", stored, at)
        body = stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", stored, at + 8 + n)[0]:
            raise ValueError("damaged picture")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"IDAT":
            data.append(body)
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, standard deviation and entropy of the samples and the mean step between neighbours, to six places."""
    own = np.frombuffer(payload, np.uint8)
    share = np.bincount(own, minlength=256) / len(own)
    share = share[share > 0]
    step = np.abs(np.diff(own.astype(np.int16))).mean()
    return f"{own.mean():.6f}:{own.std():.6f}:{-(share * np.log2(share)).sum():.6f}:{step:.6f}"


class TarWriter:
    def __init__(self, path: str):
        self.path, self.at = path, 0
        fs, at = file_system(path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.out, self.known = fs.open_output_stream(at), {}

    def add(self, digest: str, data: bytes) -> tuple[int, int]:
        """Offset and length of the content, which is written unless the shard has it."""
        if digest not in self.known:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + data + b"\0" * (-len(data) % 512))
            self.known[digest] = (self.at + len(head), len(data))
            self.at += len(head) + len(data) + -len(data) % 512
        return self.known[digest]

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()


def placed(docs: DataFrame, text: str = "text") -> DataFrame:
    """The written places of the rows' pictures: doc_id, digest (sha256 of the stored picture), shard (path), offset and length, where
    the row's own task has put them.

    A null text is stored as an empty one; equal texts have equal digests; repeated rows stay; other columns are left out; an
    empty table gives no places."""
    spark = docs.sparkSession
    folder = common.scratch(spark, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for part in common.slices(batch, "__text", 16 << 20):
                rows = []
                for text in part["__text"].to_pylist():
                    if shard is None or shard.at > SHARD_BYTES:
                        if shard:
                            shard.close()
                        shard = TarWriter(f"{folder}/{uuid.uuid4().hex}.tar")
                    data = picture(padded(text))
                    digest = hashlib.sha256(data).hexdigest()
                    rows.append((digest, shard.path, *shard.add(digest, data)))
                if rows:
                    yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(c) for c in map(list, zip(*rows, strict=True)))], ["doc_id", "digest", "shard", "offset", "length"])
        if shard:
            shard.close()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text(text).alias("__text"))
    return common.written(source.mapInArrow(run, "doc_id long, digest string, shard string, offset long, length long"), "media-places")


def addresses(places: DataFrame) -> DataFrame:
    """One address (shard, offset, length) of each digest, and n, its rows."""
    return places.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"), F.count("*").alias("n")).select("digest", "n", "at.*")


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """The index: doc_id, digest, shard, offset and length of each row, all rows of a content with one address (other shards that met it
    keep an unused copy)."""
    places = placed(docs, text)
    return common.salted_join(places.select("doc_id", "digest"), addresses(places), ["digest"], "n", places.count(), spread=("doc_id",)).select("doc_id", "digest", "shard", "offset", "length")


def dealt(each: DataFrame) -> DataFrame:
    """Addresses dealt to tasks by bytes, in the order of the shards."""
    size = each.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()["bytes"]
    return each.repartitionByRange(max(1, -(-size // TASK_BYTES)), "shard", "offset").sortWithinPartitions("shard", "offset")


class Ranges:
    """Range reads of shards, one file open at a time."""

    def __init__(self) -> None:
        self.path, self.file = None, None

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path:
            if self.file:
                self.file.close()
            fs, at = file_system(path)
            self.path, self.file = path, fs.open_input_file(at)
        self.file.seek(offset)
        return self.file.read(length)


def metadata(index: DataFrame) -> DataFrame:
    """`index` with the columns width, height and bits of its pictures, from range reads of their headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges()
        for batch in batches:
            heads = [ranges.read(p, o, HEADER) for p, o in zip(batch["shard"].to_pylist(), batch["offset"].to_pylist(), strict=True)]
            rows = [struct.unpack_from(">IIB", h, 16) for h in heads]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[i] for r in rows], "int32") for i in range(3))], [*batch.schema.names, "width", "height", "bits"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema)
    return index.mapInArrow(run, f"{fields}, width int, height int, bits int")


FEATURES = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}


def features(each: DataFrame) -> DataFrame:
    """`each` (contents by shard and offset) with the columns of FEATURES, from the stored bytes: n_bytes (without padding),
    payload_bytes, payload_sha256, tail_crc32 (of the last 32 bytes), media_bytes, media_sha256, feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges()
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(batch[c].to_pylist() for c in ("shard", "offset", "length")), strict=True):
                stored = ranges.read(path, offset, length)
                payload = samples(stored)
                rows.append((len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload)))
            columns = [pa.array([r[i] for r in rows], "int64" if k == "long" else k) for i, k in enumerate(FEATURES.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *FEATURES])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in each.schema)
    return each.mapInArrow(run, f"{fields}, " + ", ".join(f"{n} {k}" for n, k in FEATURES.items()))


def read_back(index: DataFrame) -> DataFrame:
    """Per row of `index` (or of places): doc_id, the columns of FEATURES, and the address digest, shard, offset, length with the metadata width,
    height and bits. Each content is read once, its header by `metadata` and the whole by `features`."""
    each = common.written(addresses(index), "media-contents")
    known = features(metadata(dealt(each)))
    return common.salted_join(index.select("doc_id", "digest"), known, ["digest"], "n", index.count(), spread=("doc_id",), counts=each).select("doc_id", *FEATURES, "digest", "shard", "offset", "length", "width", "height", "bits")


def members(data: bytes) -> list[str]:
    """Names in a tar shard, by the standard library's reader."""
    return tarfile.open(fileobj=io.BytesIO(data)).getnames()
