"""Canonical exact digests: equal up to Unicode compatibility, case and white space.

A text is normalised (NFKC, case folding, NFKC again), its white space folded to single spaces and trimmed, and hashed by
128-bit XXH3. Rows of equal digest form a bucket; inside it the canonical bytes are compared with those of the bucket's
representative (smallest doc_id), and a row whose bytes differ gets a fingerprint of its own.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def canonical(text: str) -> bytes:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode()


def digest(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and fp (the digest) of each row; a null text counts as empty, repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "__text", 8 << 20):
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([digest(canonical(t)) for t in part["__text"].to_pylist()], "string")], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text(text).alias("__text")).mapInArrow(run, "doc_id long, fp string")


def collisions(proofs: DataFrame) -> DataFrame:
    """proofs: doc_id, fp, proof (canonical bytes) of documents in shared buckets. doc_id, fp and own (sha256 of the bytes) of
    those whose bytes aren't their representative's.

    Members meet the bytes of their bucket's representative in a join by digest; large buckets are dealt to several tasks."""
    firsts = proofs.groupBy("fp").agg(F.min_by("proof", "doc_id").alias("expected"), F.count("*").alias("n"))
    return common.salted_join(proofs, firsts, ["fp"], "n", proofs.count(), spread=("doc_id",)).filter("proof != expected").select("doc_id", "fp", F.sha2("proof", 256).alias("own")).distinct()


def neighbours(docs: DataFrame, rows_per_range: int = 2048, most_ranges: int = 50_000, text: str = "text") -> DataFrame:
    """Per document, in descending doc_id: doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next, and proof, the
    canonical bytes (compressed, which keeps equal and unequal ones so) of documents in buckets of several, else null.

    The edited text has its last floor(n_chars/3) code points replaced by as many first ones (or all) of the next document;
    after the last comes the first, and a single document is its own next. Likeness is 1 for equal canonical bytes and 0
    otherwise. Null texts are empty; rows of equal doc_id are ordered by a hash of their text, a null doc_id comes last.

    Documents are dealt to ranges of doc_id (between quantiles), each with a copy of the next range's first document and the
    (doc_id, digest) of its documents in shared buckets, so texts move once.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text(text).alias("text"))
    size = source.agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).first()
    ranges = max(1, min(most_ranges, -(-size["n"] // rows_per_range)))
    bounds: list[int] = []
    if ranges > 1 and size["least"] is not None:
        cuts = [i / ranges for i in range(1, ranges)]
        bounds = sorted(set(source.agg(F.percentile_approx("doc_id", cuts, max(10_000, 20 * ranges)).alias("cuts")).first()["cuts"]))
    edges = np.array(bounds, np.int64)
    n = len(bounds) + 1

    def placed(ids: pa.Array) -> pa.Array:
        at = len(edges) - np.searchsorted(edges, ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "left")  # descending
        return pa.array(at, "int32")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([placed(batch["doc_id"]), *batch.columns], ["range", *batch.schema.names])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(3)
        for batch in batches:
            for part in common.slices(batch, "text", 8 << 20):
                at = part["range"] if "range" in part.schema.names else placed(part["doc_id"])
                yield pa.RecordBatch.from_arrays([at, part["doc_id"], part["tie"], pa.array([packer.compress(t.encode()) for t in part["text"].to_pylist()], "binary")], ["range", "doc_id", "tie", "text"])

    tops = source.select("doc_id").mapInArrow(number, "range int, doc_id long").groupBy("range").agg(F.max("doc_id").alias("top"))
    heads = {r["range"]: r["top"] for r in tops.collect()}  # a row a range
    order = sorted(heads)
    before = {heads[r]: order[i - 1] for i, r in enumerate(order)}  # first document of a range -> the range before it
    tied = source.withColumn("tie", F.xxhash64("text"))
    packed = "range int, doc_id long, tie long, text binary"
    dealt = tied.mapInArrow(squeeze, packed).withColumn("kind", F.lit(1))
    firsts = spark.createDataFrame([(k, v) for k, v in before.items()], "top long, range int")  # as many rows as ranges
    whole = tied.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("top")))
    guests = whole.groupBy("range", "doc_id").agg(F.max("tie").alias("tie"), F.max_by("text", "tie").alias("text")).mapInArrow(squeeze, packed).withColumn("kind", F.lit(2))
    known = common.written(digests(docs, text).distinct(), "digests")
    shared = common.salted_join(known, known.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1"), ["fp"], "n", size["n"], spread=("doc_id",)).select("doc_id", F.lit(0).cast("long").alias("tie"), F.col("fp").cast("binary").alias("text"))
    marks = shared.mapInArrow(number, packed).withColumn("kind", F.lit(0))
    every = dealt.unionByName(guests).unionByName(marks).repartitionById(n, F.col("range")).sortWithinPartitions("range", "kind", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, proven, within = None, set(), None  # held: (range, doc_id, text, canonical)
        unpacker, packer = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(3)
        for batch in batches:
            for part in common.slices(batch, "text", 4 << 20):
                out = []
                for at, doc, text, kind in zip(*(part[c].to_pylist() for c in ("range", "doc_id", "text", "kind")), strict=True):
                    if at != within:
                        within, proven = at, set()
                    if kind == 0:
                        proven.add((doc, text.decode()))
                        continue
                    text = unpacker.decompress(text).decode()
                    own = canonical(text)
                    if held is not None and held[0] == at:
                        *row, proof = compared(held, text, own, proven)
                        out.append((*row, proof and packer.compress(proof)))
                    held = None if kind == 2 else (at, doc, text, own)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), ("int64", "int64", "string", "string", "string", "float64", "float64", "binary"), strict=True)], ["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next", "proof"])

    return every.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fp string, edited_fp string, near_edited double, near_next double, proof binary")


def compared(held: tuple, following: str, its: bytes, proven: set) -> tuple:
    _, doc, text, own = held
    third = len(text) // 3
    edited = text[: len(text) - third] + following[:third]
    changed, fp = canonical(edited), digest(own)
    return doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp, digest(changed), float(own == changed), float(own == its), own if (doc, fp) in proven else None


def fingerprinted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of `neighbours` with fingerprint, the digest after byte comparison inside buckets, and edited_fingerprint,
    which is the document's own where the edited text's canonical bytes are the document's."""
    rows = common.written(neighbours(docs, text=text), "neighbours")
    differ = common.written(collisions(rows.filter("proof is not null").select("doc_id", "fp", "proof")), "collisions")
    if differ.isEmpty():
        rows = rows.withColumn("own", F.lit(None).cast("string"))
    else:
        rows = rows.join(differ.withColumnRenamed("doc_id", "__id").withColumnRenamed("fp", "__fp"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("fp") == F.col("__fp")), "left")
    fingerprint = F.concat_ws("-", "fp", "own")
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint.alias("fingerprint"), F.when(F.col("near_edited") == 1, fingerprint).otherwise(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")
