"""Toxicity by a convolutional text classifier on hashed word embeddings, trained in numpy.

Words are hashed into 2^26 buckets; buckets that occur in several training texts have an embedding, the others share a
zero one. Filters of several widths run over the words, each keeps its maximum over the text, and a logistic layer gives
a probability. For scoring, embedding and filter weights are multiplied out to one table a filter position, so a text
costs some table look-ups a word. The language of a text is guessed from its words (naive Bayes over the same buckets);
a threshold is chosen for each language on training rows that the classifier didn't see, and scores are shifted on the
logit scale so that the threshold of the text's language becomes 0.5.

The training sample is bounded by `most_rows`; the rows with the least hash of doc_id are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .wordbpe import Recent

SPACE = (1 << 26) - 1
EMPTY, PAD, FIRST = 0, 1, 2
NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
MOST_WORDS = 60_000


def bucket(word: bytes) -> int:
    """Of the word's letters, A-Z lower-cased."""
    return xxhash.xxh32_intdigest(word.lower().translate(None, NOT_LETTERS)) & SPACE


class Model:
    """tables: [width][position] -> rows x filters; languages: rows x languages of log probabilities."""

    def __init__(self, rows: dict[int, int], tables: list[list[np.ndarray]], bias: list[np.ndarray], out: np.ndarray, base: float, names: list[str], languages: np.ndarray, cuts: np.ndarray):
        self.rows, self.tables, self.bias, self.out, self.base = rows, tables, bias, out, base
        self.names, self.languages, self.cuts = names, languages, cuts
        self.words: Recent | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"words": None}

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all words, each text followed by padding, and where each text begins."""
        if self.words is None:
            self.words = Recent(lambda w: self.rows.get(bucket(w), EMPTY), MOST_WORDS)
        look, gap, parts, begins, at = self.words.__getitem__, len(self.tables), [], [], 0
        for text in texts:
            tokens = text.encode().split()
            own = np.full(max(1, len(tokens)) + gap, PAD, np.int32)
            own[: len(tokens)] = np.fromiter(map(look, tokens), np.int32, len(tokens))
            begins.append(at)
            at += len(own)
            parts.append(own)
        return np.concatenate(parts), np.array(begins)

    def logits(self, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Before the shift by language. Windows begin at words (at the first padding of a text without words)."""
        ends = np.append(begins[1:], len(ids))
        outside = ids == PAD
        outside[begins] = False
        spread = np.zeros(len(ids) + len(self.tables), np.int32) + PAD
        spread[: len(ids)] = ids
        pooled = []
        for width, tables in enumerate(self.tables, 1):
            z = tables[0][spread[: len(ids)]]
            for j in range(1, width):
                z = z + tables[j][spread[j : j + len(ids)]]
            z[outside] = -np.inf
            pooled.append(np.maximum(np.maximum.reduceat(z, begins, axis=0) + self.bias[width - 1], 0))
        assert len(ends) == len(begins)
        return np.concatenate(pooled, axis=1).astype(np.float64) @ self.out + self.base

    def language(self, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.languages[ids], begins, axis=0).argmax(1)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        ids, begins = self.ids(texts)
        return sigmoid(self.logits(ids, begins) - self.cuts[self.language(ids, begins)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(texts: list[np.ndarray], toxic: np.ndarray, langs: list[str], size: int = 16, filters: int = 8, widths: int = 3, epochs: int = 4, steps: int = 600, min_texts: int = 3, seed: int = 7) -> Model:
    """texts: bucket of each word; toxic: 0 or 1. A fifth of the rows is left for the thresholds. There are `epochs` passes, more
    where they would make fewer than `steps` steps."""
    random = np.random.default_rng(seed)
    values, n = np.unique(np.concatenate([np.unique(t) for t in texts] or [np.zeros(0, np.uint32)]), return_counts=True)
    kept = values[n >= min_texts]
    rows = {int(b): FIRST + i for i, b in enumerate(kept)}

    def numbered(t: np.ndarray) -> np.ndarray:
        if not len(t) or not len(kept):
            return np.full(max(1, len(t)), EMPTY if len(t) else PAD, np.int32)
        at = np.minimum(np.searchsorted(kept, t), len(kept) - 1)
        return np.where(kept[at] == t, FIRST + at, EMPTY).astype(np.int32)

    own = [np.append(numbered(t), np.full(widths, PAD, np.int32)) for t in texts]
    names = sorted(set(langs)) or [""]
    counts = np.ones((FIRST + len(rows), len(names)))
    for t, lang in zip(own, langs, strict=True):
        np.add.at(counts[:, names.index(lang)], t[:-widths], 1)
    languages = np.log(counts / counts.sum(0))
    languages[:FIRST] = 0

    tuned = random.random(len(own)) < 0.2
    learn = np.flatnonzero(~tuned)
    emb = random.normal(0, 0.1, (FIRST + len(rows), size))
    emb[:FIRST] = 0
    conv = [random.normal(0, 0.4, (w, size, filters)) for w in range(1, widths + 1)]
    bias = [np.zeros(filters) for _ in conv]
    out, base = random.normal(0, 0.3, filters * widths), np.zeros(1)
    base[0] = np.log((toxic.mean() + 1e-3) / (1 - toxic.mean() + 1e-3)) if len(toxic) else -3.0
    dense = [*conv, *bias, out, base]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in dense]
    second, step = np.full(len(emb), 1e-3), 0
    passes = max(epochs, -(-steps * 32 // max(32, len(learn))))
    for epoch in range(passes):
        rate = 0.02 / (1 + epoch * epochs / passes)
        for batch in np.array_split(random.permutation(learn), max(1, len(learn) // 32)) if len(learn) else ():
            grads, moved, pulls = [np.zeros_like(p) for p in dense], [], []
            every = np.concatenate([c.transpose(1, 0, 2).reshape(size, -1) for c in conv], axis=1)  # all filters at all positions
            for i in batch.tolist():
                t = own[i]
                n = len(t) - widths
                x = emb[t]
                y, first, pooled, best = x @ every, 0, [], []
                for w in range(1, widths + 1):
                    z = y[:n, first : first + filters]
                    for j in range(1, w):
                        z = z + y[j : j + n, first + j * filters : first + (j + 1) * filters]
                    first += w * filters
                    at = z.argmax(0)
                    best.append(at)
                    pooled.append(z[at, np.arange(filters)] + bias[w - 1])
                held = np.maximum(np.concatenate(pooled), 0)
                error = sigmoid(np.array([held @ out + base[0]]))[0] - toxic[i]
                grads[-1][0] += error
                grads[-2] += error * held
                back = (error * out * (held > 0)).reshape(widths, filters)
                for w in range(1, widths + 1):
                    g = back[w - 1]
                    grads[widths + w - 1] += g
                    for j in range(w):
                        at = best[w - 1] + j
                        grads[w - 1][j] += (g[:, None] * x[at]).T
                        moved.append(t[at])
                        pulls.append(g[:, None] * conv[w - 1][j].T)
            step += 1
            for p, g, (m, v) in zip(dense, grads, moments, strict=True):
                g = g / len(batch) + 1e-4 * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            touched, back = np.unique(np.concatenate(moved), return_inverse=True)
            g = np.zeros((len(touched), size))
            np.add.at(g, back, np.concatenate(pulls))
            real = touched >= FIRST
            touched, g = touched[real], g[real] / len(batch) + 1e-4 * emb[touched[real]]
            second[touched] += (g * g).mean(1)
            emb[touched] -= 4 * rate * g / np.sqrt(second[touched])[:, None]
    tables = [[(emb @ conv[w][j]).astype(np.float32) for j in range(w + 1)] for w in range(widths)]
    model = Model(rows, tables, [b.astype(np.float32) for b in bias], out, float(base[0]), names, languages.astype(np.float32), np.zeros(len(names)))
    held = np.flatnonzero(tuned) if tuned.any() else np.arange(len(own))
    if len(held):
        parts = []
        for some in np.array_split(held, max(1, len(held) // 128)):  # a few texts at once, as the filters' values are many times their size
            ids = np.concatenate([own[i] for i in some])
            begins = np.concatenate([[0], np.cumsum([len(own[i]) for i in some])[:-1]])
            parts.append((model.logits(ids, begins), model.language(ids, begins)))
        logits, lang = (np.concatenate(p) for p in zip(*parts, strict=True))
        every = threshold(logits, toxic[held], 0.0)
        model.cuts = np.array([threshold(logits[lang == k], toxic[held][lang == k], every) for k in range(len(names))])
    return model


def threshold(logits: np.ndarray, toxic: np.ndarray, default: float, least: int = 20) -> float:
    """The logit with the best F1 on these rows, amid the widest gap among equals; with few toxic rows the default."""
    if toxic.sum() < least or toxic.sum() == len(toxic):
        return default
    order = np.argsort(-logits, kind="stable")
    own, hits = logits[order], np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(own) + 1) + toxic.sum())
    good = np.flatnonzero(f1[:-1] >= f1.max() - 1e-9) if len(own) > 1 else []
    if not len(good):
        return default
    k = max(good, key=lambda i: own[i] - own[i + 1])
    return float((own[k] + own[k + 1]) / 2)


def fold() -> F.Column:
    """crc32 of doc_id as text, modulo 5; -1 for a null doc_id, which is in no fold."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)), F.lit(-1))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 16_000, most_bytes: int = 128 << 20, text: str = "text", **how) -> Model:
    """A model from labelled rows whose fold isn't 0: those with the least hash of doc_id, at most `most_rows` of them and at most
    `most_bytes` of word hashes (four bytes a word; a text with more is passed over, and it is an error if none is left). Rows without a label, doc_id or document are
    left out; a doc_id labelled several times counts as toxic if one label says so; of the documents of a doc_id one is taken;
    without any labels, or with a bound of 0, every score is low."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(fold() != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), common.whole_text(text).alias("__text")).join(F.broadcast(sample), "doc_id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Recent(bucket, MOST_WORDS)
        for batch in batches:
            for part in common.slices(batch, "__text", 8 << 20):
                own = [np.fromiter(map(words.__getitem__, t.encode().split()), np.uint32).tobytes() for t in part["__text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["lang"], part["toxic"].cast("int32"), pa.array(own, "binary")], ["doc_id", "lang", "toxic", "words"])
        common.trimmed()

    each = texts.mapInArrow(hashed, "doc_id long, lang string, toxic int, words binary").groupBy("doc_id").agg(F.min(F.struct("words", "lang", "toxic")).alias("row"))
    one = common.written(each.select("doc_id", "row.*", F.xxhash64("doc_id").alias("order")), "toxicity-sample")
    lengths = np.array([tuple(r) for r in one.select("order", F.octet_length("words")).orderBy("order", "doc_id").collect()], np.int64).reshape(-1, 2)  # at most most_rows
    if not len(lengths) or not most_bytes:
        return train([], np.zeros(0, np.int64), [], **how)
    fits = lengths[lengths[:, 1] <= most_bytes]  # a text beyond the bound alone is passed over
    whole = fits[np.cumsum(fits[:, 1]) <= most_bytes, 0]
    if not len(whole):
        raise ValueError(f"no labelled text fits the sample's {most_bytes} bytes")
    rows = one.filter((F.col("order") <= int(whole[-1])) & (F.octet_length("words") <= most_bytes)).toArrow()
    rows = rows.take(pa.compute.sort_indices(rows["doc_id"]))
    words = [np.frombuffer(w.as_buffer(), np.uint32) for w in rows["words"]]  # views: the driver holds the sample once
    model = train(words, (rows["toxic"].to_numpy() > 0).astype(np.int64), rows["lang"].to_pylist(), **how)
    del words, rows
    common.trimmed()
    return model


def scored(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and score of each row of `docs`, from its text alone; a null text counts as empty and repeated rows
    stay."""
    source = docs.select(*keep, common.whole_text(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "__text", 4 << 20):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(model.scores(part["__text"].to_pylist()), "float64")], [*part.schema.names[:-1], "score"])
        model.words = None
        common.trimmed()

    return source.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]) + ", score double")


def clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` without the rows whose score is 0.5 or more; columns as before."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, batch.schema.names[at], 4 << 20):
                yield part.filter(pa.array(model.scores([t or "" for t in part.column(at).to_pylist()]) < 0.5))
        model.words = None
        common.trimmed()

    return docs.mapInArrow(run, kinds)
