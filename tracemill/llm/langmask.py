"""Language identification by bit-sliced Bloom filters of character n-grams.

A table of 2^b rows holds a mask of languages a row: the row of a hash is that hash's bit in the filters of all languages,
so the conjunction of the few rows of an n-gram is the mask of the languages that contain it. A text's n-grams set
bits in a plane a language; the planes' popcounts, less the false positives that each filter's fill makes likely, are shares of
the text that a language explains, and the greatest share decides.

N-grams lie within a word and its borders: runs of letters and marks, in lower case, between single spaces. A language
contains an n-gram that it uses at least `share` times as often, per n-gram, as the language that uses it most, and that its sample has
`least` times.

A text that is null or has no letter is `und` with score 0; so is every text where nothing could be learned. Ties go to the
language with more rows, then to the smaller name. Repeated rows stay; columns other than doc_id, text and lang are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .toxicity import fold

SIZES = (3, 4)
HASHES = 3
WINDOW = 1 << 20
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Of each code point: 2 a letter, 1 a mark (part of words), 0 neither."""
    if not _kinds:
        _kinds.append(np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8))
    return _kinds[0]


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all texts, each text's words behind single spaces; where each text begins (and the end); and
    which texts have a letter."""
    codes = np.frombuffer("".join(" " + t.lower() for t in texts).encode("utf-32-le") + b" \0\0\0", np.uint32)
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t.lower()) + 1 for t in texts], out=begins[1:])
    kind = kinds()[codes]
    lettered = np.add.reduceat(kind == 2, begins[:-1]) > 0
    inside = kind > 0
    kept = inside.copy()
    kept[1:] |= inside[:-1]  # the first of a run of others stays, as a space
    kept[begins] = True  # and the one before each text
    at = np.concatenate([[0], np.cumsum(kept)])
    return np.where(inside, codes, 32)[kept], at[begins], lettered


def grams(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of a word with its borders, and where each begins."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    within = codes != 32
    good = np.ones(n, bool)
    for j in range(1, size - 1):
        good &= within[j : j + n]
    at = np.flatnonzero(good)
    h = np.full(len(at), size, np.uint64)
    for j in range(size):
        h = (h ^ codes[at + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h, at


def rows_of(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The table rows of hashes: odd steps from the high half, as in double hashing."""
    begin, step, low = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1), np.uint64((1 << bits) - 1)
    return [((begin + np.uint64(i) * step) & low).astype(np.int64) for i in range(HASHES)]


def popcounts(plane: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Set bits of the plane between consecutive `begins`."""
    packed = np.packbits(plane)
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
    byte, rest = begins >> 3, begins & 7
    part = np.append(packed, 0)[byte] >> (8 - rest).astype(np.uint8)
    return np.diff(before[byte] + np.where(rest > 0, np.bitwise_count(part.astype(np.uint8)), 0))


class Model:
    """names: languages, most rows first; table: words of 64 languages x rows; wrong: each filter's rate of false positives."""

    def __init__(self, names: list[str], table: np.ndarray, bits: int):
        self.names, self.bits = names, bits
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if len(names) <= 8 * np.dtype(k).itemsize or k is np.uint64)
        self.table = table.astype(kind)
        self.wrong = np.array([float(np.mean(self.table[i // 64] >> kind(i % 64) & kind(1))) ** HASHES for i in range(len(names))])

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text the n-grams that each language contains, all n-grams, and whether it has a letter. Long texts pass in windows."""
        codes, begins, lettered = folded(texts)
        hits, every = np.zeros((len(texts), len(self.names)), np.int64), np.zeros(len(texts), np.int64)
        for first in range(0, len(codes), WINDOW):
            for size in SIZES:
                h, at = grams(codes[first : first + WINDOW + size - 1], size)
                edges = np.searchsorted(at, begins - first)  # of texts, among the n-grams
                every += np.diff(edges)
                places = rows_of(h, self.bits)
                for w, table in enumerate(self.table):
                    mask = table[places[0]]
                    for p in places[1:]:
                        mask &= table[p]
                    for i in range(64 * w, min(64 * w + 64, len(self.names))):
                        hits[:, i] += popcounts(mask & table.dtype.type(1 << (i % 64)) != 0, edges)
        return hits, every, lettered

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not texts or not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        hits, every, lettered = self.counts([t or "" for t in texts])
        shares = np.clip((hits / np.maximum(every, 1)[:, None] - self.wrong) / np.maximum(1 - self.wrong, 1e-9), 0, 1)
        best = shares.argmax(1)
        score = shares[np.arange(len(texts)), best] / np.maximum(shares.sum(1), 1e-12)
        return [self.names[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], np.where(lettered, np.minimum(score, 1), 0.0)


def fit(docs: DataFrame, text: str = "text", most_rows: int = 4000, most_langs: int = 256, least: int = 3, share: float = 0.3) -> Model:
    """A model from the rows with a language whose fold isn't 0: about `most_rows` of each language (those whose hash of doc_id and
    text is below its share), of the `most_langs` languages with the most rows. N-grams are counted and masks made by Spark;
    only the table, whose size follows from the n-grams of a language, comes to the driver."""
    spark = docs.sparkSession
    learn = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), common.whole_text(text).alias("__text")).filter("lang is not null").filter(fold() > 0)
    seen = learn.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()
    names = [r["lang"] for r in seen]
    if not names:
        return Model([], np.zeros((1, 1), np.uint64), 0)
    part = spark.createDataFrame([(r["lang"], i, min(1.0, most_rows / r["count"])) for i, r in enumerate(seen)], "lang string, number int, part double")
    drawn = F.pmod(F.xxhash64("doc_id", "__text"), F.lit(1 << 30)) < F.col("part") * float(1 << 30)
    sample = learn.join(F.broadcast(part), "lang").filter(drawn).select("number", "__text")  # at most most_langs rows are broadcast

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch, "__text", 4 << 20):
                number = piece["number"].to_numpy()
                for i in np.unique(number):
                    codes, _, _ = folded(piece["__text"].filter(pa.array(number == i)).to_pylist())
                    for first in range(0, len(codes), WINDOW):
                        for size in SIZES:
                            h, n = np.unique(grams(codes[first : first + WINDOW + size - 1], size)[0], return_counts=True)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i, np.int32)), pa.array(h.view(np.int64)), pa.array(n)], ["number", "gram", "n"])
        common.trimmed()

    used = common.written(sample.mapInArrow(counted, "number int, gram long, n long").groupBy("gram", "number").agg(F.sum("n").alias("n")), "grams")
    total = used.groupBy("number").agg(F.sum("n").alias("total"), F.count_if(F.col("n") >= least).alias("own"))
    sizes = total.collect()  # a row a language
    bits = int(np.clip(np.ceil(np.log2(16 * max([r["own"] for r in sizes] or [1]) + 1)), 10, 26))
    rated = used.join(F.broadcast(total), "number").select("gram", "n", (F.col("n") / F.col("total")).alias("rate"), F.struct("number", "n", (F.col("n") / F.col("total")).alias("rate")).alias("one"))
    # a language has one row of a gram, so groups are as small as the number of languages
    masks = rated.groupBy("gram").agg(F.max("rate").alias("most"), F.collect_list("one").alias("every")).select("gram", "most", F.explode("every").alias("one"))
    masks = masks.filter((F.col("one.n") >= least) & (F.col("one.rate") >= share * F.col("most"))).select("gram", (F.col("one.number") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, one.number % 64)").alias("mask"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in rows_of(batch["gram"].to_numpy().view(np.uint64), bits):
                yield pa.RecordBatch.from_arrays([pa.array(place), batch["word"], batch["mask"]], ["place", "word", "mask"])

    table = np.zeros((-(-len(names) // 64), 1 << bits), np.uint64)
    got = masks.groupBy("gram", "word").agg(F.bit_or("mask").alias("mask")).mapInArrow(spread, "place long, word int, mask long").groupBy("place", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    table[got["word"].to_numpy(), got["place"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    common.dropped(used)
    return Model(names, table, bits)


def identified(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, lang_pred and score of each row of `docs`, from its text alone."""
    source = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    told = docs.sparkSession.sparkContext.broadcast(model)  # as large as the table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "__text", 4 << 20):
                lang, score = told.value.predict(part["__text"].to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, "string"), pa.array(score, "float64")], [*part.schema.names[:-1], "lang_pred", "score"])
        common.trimmed()

    return source.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]) + ", lang_pred string, score double")
