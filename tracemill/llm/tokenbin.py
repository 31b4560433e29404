"""Token ids in fixed-width bit-packed files.

A shard file holds the ids of documents in ascending doc_id, each id in the minimum number of bits of the vocabulary:

    header   magic, width, ids per block, ids, documents          (struct HEAD)
    blocks   BLOCK ids each, packed little-endian, padded to a multiple of 64 ids
    footer   byte offset of each block, doc_id of each document (ABSENT for null), first id of each document, and one more
    tail     offset of the footer, magic

64 ids of any width fill whole 64-bit words, so a block is packed and unpacked by 64 vector operations, and a range of
ids needs only the blocks that it touches.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import file_system
from .wordbpe import LETTERS, Recent

MAGIC = b"TMBITS01"
HEAD = struct.Struct("<8sIIQQ")
BLOCK = 1 << 14
ABSENT = -(1 << 63)
MOST_WORDS, MOST_RUNS = 500_000, 100_000
RUNS = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[!-&(-/:-@[-`{-~]+|\n(?! )").findall
SPACE_THEN_BLANK = re.compile(r" \s").search


def pack(ids: np.ndarray, width: int) -> bytes:
    rows = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    rows.reshape(-1)[: len(ids)] = ids
    words = np.zeros((len(rows), width), np.uint64)
    for j in range(64):
        at, shift = divmod(j * width, 64)
        words[:, at] |= rows[:, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, at + 1] |= rows[:, j] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    words = np.frombuffer(data, "<u8").reshape(-1, width)
    rows, mask = np.empty((len(words), 64), np.uint32), np.uint64((1 << width) - 1)
    for j in range(64):
        at, shift = divmod(j * width, 64)
        value = words[:, at] >> np.uint64(shift)
        if shift + width > 64:
            value = value | words[:, at + 1] << np.uint64(64 - shift)
        rows[:, j] = value & mask
    return rows.reshape(-1)[:n]


class Writer:
    def __init__(self, path: str, width: int):
        fs, at = file_system(path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.out, self.width, self.held, self.n_held = fs.open_output_stream(at), width, [], 0
        self.out.write(HEAD.pack(MAGIC, width, BLOCK, 0, 0))
        self.offsets, self.ids, self.starts, self.total, self.at = [], [], [], 0, HEAD.size

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(ABSENT if doc_id is None else doc_id)
        self.starts.append(self.total)
        self.total += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            self.flush(self.n_held // BLOCK * BLOCK)

    def flush(self, n: int) -> None:
        every = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for i in range(0, n, BLOCK):
            data = pack(every[i : min(n, i + BLOCK)], self.width)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.held, self.n_held = [every[n:]], len(every) - n

    def close(self) -> None:
        self.flush(self.n_held)
        for values, kind in (([*self.offsets, self.at], "<u8"), (self.ids, "<i8"), ([*self.starts, self.total], "<u8")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(struct.pack("<QQQ8s", self.at, self.total, len(self.ids), MAGIC))
        self.out.close()


class Reader:
    """Random access to the ids and documents of a shard file; only the footer is held."""

    def __init__(self, path: str):
        fs, at = file_system(path)
        self.file = fs.open_input_file(at)
        magic, self.width, self.block, _, _ = HEAD.unpack(self.read(0, HEAD.size))
        foot, self.total, self.n_docs, end = struct.unpack("<QQQ8s", self.read(self.file.size() - 32, 32))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"{path} isn't a whole shard file")
        n = -(-self.total // self.block) + 1
        data = self.read(foot, (n + 2 * self.n_docs + 1) * 8)
        self.offsets = np.frombuffer(data, "<u8", n)
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, 8 * n)
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, 8 * (n + self.n_docs)).astype(np.int64)

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (stop - 1) // self.block
        data = self.read(int(self.offsets[a]), int(self.offsets[b + 1] - self.offsets[a]))
        first = a * self.block
        return unpack(data, min(self.total, (b + 1) * self.block) - first, self.width)[start - first : stop - first]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, first id and ids of each document, read some blocks at a time."""
        k = 0
        while k < self.n_docs:
            last = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + 64 * self.block, "right")) - 1)
            ids = self.ids(int(self.starts[k]), int(self.starts[last]))
            for i in range(k, last):
                doc = int(self.doc_ids[i])
                yield None if doc == ABSENT else doc, int(self.starts[i]), ids[self.starts[i] - self.starts[k] : self.starts[i + 1] - self.starts[k]]
            k = last


class Encoder:
    """Ids of whole texts as the library gives them; the ids of a word with the space before it are kept for the task."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = "<u2" if self.tokenizer.get_vocab_size(True) <= 1 << 16 else "<u4"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words, self.runs = Recent(self.new_word, MOST_WORDS), Recent(self.new_run, MOST_RUNS)
        self.bytes = [self.packed([i]) for i in range(self.tokenizer.get_vocab_size(True))]

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def new_run(self, piece: str) -> bytes:
        return self.written(piece.encode().decode("latin-1").translate(LETTERS))

    def written(self, piece: str) -> bytes:
        """Ids of a run in the letters that stand for its bytes."""
        own = self.bytes
        return b"".join([own[t.id] for t in self.tokenizer.model.tokenize(piece)])

    def new_word(self, raw: bytes) -> bytes:
        if raw.isalpha():  # A-Z alone: one run, whose letters stand for themselves
            return self.written(LETTERS[32] + raw.decode("ascii"))
        word = " " + raw.decode()
        runs = RUNS(word)
        if len(runs) == 1 and runs[0] == word:
            return self.runs[word] if len(word) < 8 else self.new_run(word)
        if "".join(runs) == word:
            return b"".join([self.runs[r] for r in runs])
        return self.packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def text(self, text: str) -> bytes:
        if SPACE_THEN_BLANK(text) or any(s in text for s in self.special):  # what stands before a space matters there
            return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        first, *rest = text.encode().split(b" ")
        return self.packed(self.tokenizer.encode(first.decode(), add_special_tokens=False).ids) + b"".join(map(self.words.__getitem__, rest))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write(docs: DataFrame, tokenizer: str, end_id: int | None = 2, rows_per_shard: int = 4096, most_shards: int = 50_000, text: str = "text") -> DataFrame:
    """Write the ids of all texts in ascending doc_id to shard files in the shared folder and return the table of shards:
    shard, path, n_docs, n_tokens.

    Shards are ranges of doc_id between quantiles of `docs`; beyond most_shards they get longer instead of more. A null
    text counts as empty (its end id alone), null doc_ids come first, rows of equal doc_id are ordered by their ids,
    repeated rows stay. An empty table gives no shards. A task that is run again writes a file of another name and
    only the table's files count.
    """
    spark = docs.sparkSession
    n = docs.count()
    shards = max(1, min(most_shards, -(-n // rows_per_shard)))
    bounds = np.zeros(0, np.int64)
    if shards > 1:
        cuts = [i / shards for i in range(1, shards)]
        found = docs.agg(F.percentile_approx("doc_id", cuts, max(10_000, 20 * shards)).alias("cuts")).first()["cuts"]
        bounds = np.unique(np.array(found or [], np.int64))
    vocabulary = encoder(tokenizer).tokenizer.get_vocab_size(True)
    width = max(1, (max(vocabulary - 1, end_id or 0)).bit_length())
    folder = common.scratch(spark, "bits")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        tail = b"" if end_id is None else own.packed([end_id])
        for batch in batches:
            for part in common.slices(batch, "__text", 8 << 20):
                ids = [own.text(t) + tail for t in part["__text"].to_pylist()]
                at = np.searchsorted(bounds, pa.compute.fill_null(part["doc_id"], ABSENT).to_numpy(zero_copy_only=False), "left")
                yield pa.RecordBatch.from_arrays([pa.array(at, "int32"), part["doc_id"], pa.array(ids, "binary")], ["shard", "doc_id", "ids"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, writer, shard, path, done = encoder(tokenizer), None, None, "", []

        def end() -> None:
            writer.close()
            done.append((shard, path, len(writer.ids), writer.total))

        for batch in batches:
            for at, doc, ids in zip(*(batch[c].to_pylist() for c in ("shard", "doc_id", "ids")), strict=True):
                if at != shard:
                    if writer:
                        end()
                    shard, path = at, f"{folder}/{at:07d}-{uuid.uuid4().hex}.bits"
                    writer = Writer(path, width)
                writer.add(doc, np.frombuffer(ids, own.kind))
        if writer:
            end()
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*done, strict=True) if done else [[]] * 4, ("int32", "string", "int64", "int64"), strict=True)], ["shard", "path", "n_docs", "n_tokens"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text(text).alias("__text"))
    rows = source.mapInArrow(encode, "shard int, doc_id long, ids binary")
    dealt = rows.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "ids")
    return common.written(dealt.mapInArrow(store, "shard int, path string, n_docs long, n_tokens long"), "shards")


def read(shards: DataFrame) -> DataFrame:
    """The documents of written shards, read back: doc_id, start (ids of all documents before it), n_tokens and
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers). Memory: some blocks and one document."""
    spark = shards.sparkSession
    known = sorted((r["shard"], r["path"], r["n_tokens"]) for r in shards.collect())  # as many rows as shards, which write() bounds
    bases = np.concatenate([[0], np.cumsum([k[2] for k in known])]).tolist()
    files = spark.createDataFrame([(k[1], b) for k, b in zip(known, bases, strict=False)], "path string, base long").repartition(max(1, len(known)))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist(), strict=True):
                rows = [(doc, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, start, ids in Reader(path).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), "int64") for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(back, "doc_id long, start long, n_tokens long, ids_crc32 long")
