"""Encoding and decoding through a distinct-word table.

1. Texts are split into words, block by block. A block's distinct words are numbered as they are met; a document becomes
   the sequence of its words' numbers, and the distinct words go to buckets by their hash, packed. Both are written.
2. The buckets are the distinct-word table: a word's bucket holds it once, however many blocks and documents have it,
   and encodes it once. What goes back to a block are the ids of its words.
3. Ids are joined back to documents by position: numbers index the ids of the block's words. Documents don't move for
   this; the ids of a block's words lie in a file of the shared folder that has the block's name.
4. Decoding joins ids to the table of pieces, which is as long as the vocabulary, and pieces by position to texts.

So no text is shuffled, and nothing that grows with the corpus is broadcast or collected.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import file_system

#: Distinct words of a block; words that a bucket's task holds at once (beyond it a word met again is encoded again).
BLOCK_WORDS, MOST_WORDS, MOST_RUNS = 800_000, 250_000, 30_000
RUNS = re.compile("[a-zà-öø-ÿ]+|[0-9]|[!-&(-/:-@[-`{-~]+").findall
ALREADY_LOWER = re.compile("[^A-ZÀ-ÖØ-Þ]*").fullmatch
LOWER = {c: c + 32 for r in ((0x41, 0x5B), (0xC0, 0xD7), (0xD8, 0xDF)) for c in range(*r)}


def byte_letters() -> dict[int, str]:
    """Byte-level pieces write a byte as a letter: printable Latin-1 as it is, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}


LETTERS = byte_letters()


class Recent(dict):
    """Values by key, made when first asked for; two generations of at most `most` keys bound the memory."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class WordTable:
    """Encodes texts with the tokenizer at `path`; ids and decoded text equal the library's for the whole text."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pieces = {i: self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size(True))}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.runs = Recent(self.new_run, MOST_RUNS)

    def new_run(self, piece: str) -> list[int]:
        """One run of letters or of punctuation, or a digit, which the library never splits before merging."""
        written = piece.encode().decode("latin-1").translate(LETTERS)
        return [t.id for t in self.tokenizer.model.tokenize(written)]

    def word(self, raw: bytes) -> list[int]:
        """Ids of a word. Words end at ASCII white space, at which the library's own splitting never joins what stands on
        both sides."""
        word = raw.decode()
        small = word if ALREADY_LOWER(word) else word.translate(LOWER)
        runs = RUNS(small)
        if len(runs) == 1 and runs[0] == small:
            return self.runs[small]
        if "".join(runs) == small and not any(s in word for s in self.special):
            return [i for r in runs for i in self.runs[r]]
        return self.tokenizer.encode(word, add_special_tokens=False).ids  # apostrophes, other scripts, special tokens


_tables: dict[str, WordTable] = {}


def word_table(path: str) -> WordTable:
    if path not in _tables:
        _tables[path] = WordTable(path)
    return _tables[path]


class Numbers(dict):
    """Words by the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def packed(*columns: np.ndarray) -> bytes:
    """Arrays of numbers below 2^32, each in the bytes its greatest one needs, compressed. Their lengths and widths come first."""
    wide = [np.dtype("u1" if c.max(initial=0) < 256 else "<u2" if c.max() < 65536 else "<u4") for c in columns]
    head = np.array([len(columns), *(x for c, w in zip(columns, wide, strict=True) for x in (len(c), w.itemsize))], "<u4")
    return zstandard.ZstdCompressor(3).compress(b"".join([head.tobytes(), *(c.astype(w).tobytes() for c, w in zip(columns, wide, strict=True))]))


def unpacked(data: bytes) -> list[np.ndarray]:
    whole = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(whole, "<u4", 1)[0])
    head, at, out = np.frombuffer(whole, "<u4", 2 * n, 4).tolist(), 4 + 8 * n, []
    for length, width in zip(head[::2], head[1::2], strict=True):
        out.append(np.frombuffer(whole, f"<u{width}", length, at))
        at += length * width
    return out


def in_planes(numbers: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones, and so on: like bytes lie together for the file's compression."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def buckets_for(docs: DataFrame, share: int = 16 << 20, least: int = 16, most: int = 4096) -> int:
    """As many buckets of words as there are shares of the optimiser's estimate of bytes, or as partitions of a shuffle where it
    has none; changes the plan, not the result."""
    known = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if known > 1 << 60:
        return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(least, known // share))


def split(source: DataFrame, buckets: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Written rows of two kinds, by block: documents (the columns before __text, and numbers of their words), and a bucket's share
    of the block's distinct words with their numbers."""

    names = [*source.columns[:-1], "block", "numbers", "bucket", "words", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, numbers = uuid.uuid4().hex, Numbers()
        kinds = (pa.string(), pa.binary(), pa.int32(), pa.binary(), pa.binary())

        def shares(schema: pa.Schema) -> pa.RecordBatch:
            packer = zstandard.ZstdCompressor(3)
            words = list(numbers)
            of = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in words), np.uint32, len(words))
            order = np.argsort(of, kind="stable")
            own, begins = np.unique(of[order], return_index=True)
            ends = np.append(begins[1:], len(order))
            blobs = [packer.compress(b" ".join([words[i] for i in order[a:b].tolist()])) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            places = [packed(np.diff(order[a:b], prepend=0)) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            n = len(own)
            return pa.RecordBatch.from_arrays([*(pa.nulls(n, t) for t in schema.types[:-1]), pa.array([block] * n, kinds[0]), pa.nulls(n, kinds[1]), pa.array(own.astype(np.int32)), pa.array(blobs, kinds[3]), pa.array(places, kinds[4])], names)

        schema = None
        for batch in batches:
            schema = batch.schema
            for part in common.slices(batch, "__text", 8 << 20):
                rows, first = [], 0
                for k, text in enumerate(part["__text"].to_pylist(), 1):
                    tokens = text.encode().split()
                    rows.append(in_planes(np.fromiter(map(numbers.__getitem__, tokens), np.uint32, len(tokens))))
                    full = len(numbers) > block_words
                    if full or k == part.num_rows:
                        n = len(rows)
                        yield pa.RecordBatch.from_arrays([*(c.slice(first, n) for c in part.columns[:-1]), pa.array([block] * n, kinds[0]), pa.array(rows, kinds[1]), *(pa.nulls(n, k) for k in kinds[2:])], names)
                        rows, first = [], k
                    if full:
                        yield shares(schema)
                        block, numbers = uuid.uuid4().hex, Numbers()
        if numbers:
            yield shares(schema)
        del numbers
        common.trimmed()

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema[:-1]) + "block string, numbers binary, bucket int, words binary, places binary"
    out = source.mapInArrow(run, schema)
    path = common.scratch(source.sparkSession, "word-blocks")
    out.write.option("compression", "zstd").parquet(path)
    return source.sparkSession.read.schema(out.schema).parquet(path)


def encoded_words(rows: DataFrame, path: str, buckets: int) -> DataFrame:
    """block and ids (packed: steps between numbers of words, how many ids each has, ids) for each share of a block's words. A bucket's words are
    in one task, which encodes each of them once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Recent(lambda w: np.array(word_table(path).word(w), "<u4").tobytes(), MOST_WORDS)
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for words, places in zip(batch["words"].to_pylist(), batch["places"].to_pylist(), strict=True):
                ids = [known[w] for w in unpacker.decompress(words).split(b" ")]
                out.append(packed(unpacked(places)[0], np.array([len(i) // 4 for i in ids], np.uint32), np.frombuffer(b"".join(ids), "<u4")))
            yield pa.RecordBatch.from_arrays([batch["block"], pa.array(out, "binary")], ["block", "ids"])
        del known
        word_table(path).runs = Recent(word_table(path).new_run, MOST_RUNS)
        common.trimmed()

    return rows.repartitionById(buckets, F.col("bucket")).mapInArrow(run, "block string, ids binary")


def block_files(shares: DataFrame, folder: str) -> DataFrame:
    """block and n (shares) of each block, after its file in `folder` has been written: the ids of its words, share after share.

    A file is written under another name first, so a task that is lost or runs twice leaves whole files only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(folder)
        fs.create_dir(at, recursive=True)
        block, out, n, done = None, None, 0, []

        def end() -> None:
            out.close()
            try:
                fs.move(f"{at}/{block}.{token}", f"{at}/{block}")
            except OSError:  # another attempt has been faster, with the same content
                if fs.get_file_info(f"{at}/{block}").type.name != "File":
                    raise
            done.append((block, n))

        for batch in batches:
            for b, ids in zip(batch["block"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if b != block:
                    if out:
                        end()
                    block, token, n = b, uuid.uuid4().hex, 0
                    out = fs.open_output_stream(f"{at}/{b}.{token}")
                out.write(len(ids).to_bytes(8, "little") + ids)
                n += 1
        if out:
            end()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], "string"), pa.array([d[1] for d in done], "int64")], ["block", "n"])

    return shares.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block string, n long")


class BlockIds:
    """The ids of a block's words: those of word k are flat[begin[k]:begin[k] + size[k]]."""

    def __init__(self, data: bytes):
        shares, at = [], 0
        while at < len(data):
            n = int.from_bytes(data[at : at + 8], "little")
            shares.append(unpacked(data[at + 8 : at + 8 + n]))
            at += 8 + n
        words = sum(len(s[0]) for s in shares)
        self.size, self.begin = np.zeros(words, np.int64), np.zeros(words, np.int64)
        self.flat, before = np.concatenate([s[2] for s in shares]) if shares else np.zeros(0, np.uint32), 0
        for steps, sizes, ids in shares:
            places = np.cumsum(steps, dtype=np.int64)
            ends = np.cumsum(sizes, dtype=np.int64)
            self.size[places], self.begin[places] = sizes, before + ends - sizes
            before += len(ids)

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of words by position."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.begin[numbers] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def strings(ids: list[np.ndarray], names: pa.Array) -> pa.Array:
    """For each array of ids the names at them, joined by one space: an id-to-name join by position, vectorised."""
    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
    flat = pa.array(np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32))
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, "int64"), names.take(flat)), " ")


def encode_decode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digests: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of `docs`: the columns `keep`, n_tokens, and ids (decimal, space between) and decoded (pieces of
    a tokenizer without decoder, space between) or, with `digests`, their sha256 in lowercase hex.

    A null text counts as empty: no ids, decoded to the empty text. Repeated rows stay, extra columns are left out.
    Special strings in a text become their special ids, as in the library. An empty table gives no rows.
    """
    spark = docs.sparkSession
    source = docs.select(*[F.col(f"`{k}`") for k in keep], common.whole_text(text).alias("__text"))
    buckets, folder = buckets_for(docs), common.scratch(spark, "word-ids")
    blocks = split(source, buckets, block_words)
    common.written(block_files(encoded_words(blocks.filter("bucket is not null").select("block", "bucket", "words", "places"), path, buckets), folder), "word-files")
    last = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]) + f", n_tokens long, {last[0]} string, {last[1]} string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(folder)
        pieces = pa.array(list(word_table(path).pieces.values()), "string")
        numbers = pa.array(list(map(str, range(len(pieces)))), "string")
        block, table = None, None
        for batch in batches:
            for part in common.slices(batch, "numbers", 1 << 20):
                ids = []
                for b, n in zip(part["block"].to_pylist(), part["numbers"].to_pylist(), strict=True):
                    own = from_planes(n)
                    if b != block and len(own):
                        with fs.open_input_file(f"{at}/{b}") as f:
                            block, table = b, BlockIds(f.read())
                    ids.append(table.of(own) if len(own) else np.zeros(0, np.uint32))
                out = [strings(ids, numbers), strings(ids, pieces)]
                if digests:
                    out = [[hashlib.sha256(t.as_buffer() or b"").hexdigest() for t in column] for column in out]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array([len(i) for i in ids], "int64"), *(pa.array(o, "string") if digests else o.cast("string") for o in out)], [*part.schema.names[: len(keep)], "n_tokens", *last])
        table = None
        common.trimmed()

    return blocks.filter("bucket is null").select(*[F.col(f"`{k}`") for k in keep], "block", "numbers").mapInArrow(run, schema)
