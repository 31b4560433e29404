"""Personal data by patterns and a skip-chain conditional random field.

Patterns give base spans (email, ip, card, phone). Tokens with a digit or an at sign are the nodes of a random field over
the labels none, email, ip, card and phone; other tokens are none. Factors: a log-linear model of a token's form and the
word before it, a transition between neighbouring tokens, and skip factors between a token and the last one before it in
the document, however distant, that is the same but for separators, or similar (the same digits, or the same beginning),
so that evidence at one place counts at the others. Base spans are observed. Loopy sum-product runs on all documents of a
batch at once; tokens that it labels with confidence and no base span covers become further spans: a number that runs into
the next one and so fails its pattern, or a known one written with other separators.

All factors are trained together by pseudo-likelihood (each token's label given its form and its neighbours' labels) on the
base labels of a sample of documents, at most `most_docs`. Each token counts three times: whole, without its neighbours'
labels, and without its form, so that factors of the form and of the neighbours are each learnt to do without the other.
What a similar labelled token speaks for and no pattern takes is left out: its label isn't known.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY = re.compile("[0-9@]")
WHITE = re.compile(r"\s")
GROUP = re.compile("[0-9]+")
DIGITS = re.compile("[0-9]")
CORE = re.compile("[^A-Za-z0-9]")
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Start, end and kind of all pattern matches, leftmost and non-overlapping per kind, by start and then kind."""
    found: list[Span] = []
    if not ANY.search(text):
        return found
    done, at = 0, text.find("@")
    while at >= 0:  # a local part ends before the sign, so each is looked at once
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            found.append((begin, m.end(), "email"))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(DIGITS.findall(m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """Begin and end of the runs without white space that hold a digit or an at sign. Each character is looked at once."""
    done, m = 0, ANY.search(text)
    while m:
        begin = m.start()
        while begin > done and not text[begin - 1].isspace():
            begin -= 1
        after = WHITE.search(text, m.end())
        done = after.start() if after else len(text)
        yield begin, done
        m = ANY.search(text, done)


def shape(token: str, before: str = "") -> tuple[int, ...]:
    """What the form factor sees of a token: counts, each up to a bound, and the bucket of the word before."""
    letters = sum(map(str.isalpha, token))
    groups = GROUP.findall(token)
    digits = "".join(groups)
    return (
        min(20, len(digits)), min(2, token.count("@")), min(4, token.count(".")), min(3, token.count("-")),
        int(token[0] == "+"), int("(" in token), 0 if not letters else 1 if letters < 4 else 2, int(token[0].isdigit() and token[-1].isdigit()),
        int(14 <= len(digits) <= 19 and luhn(digits)), min(6, len(groups)), int(len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)),
        zlib.crc32(CORE.sub("", before).lower().encode()) % 32,
    )


BOUNDS = (21, 3, 5, 4, 2, 2, 3, 2, 2, 7, 2, 32)
OFFSETS = np.concatenate([[0], np.cumsum(BOUNDS)[:-1]])
FORM = len(BOUNDS) - 1  # features of the token itself
PAIRS = ("chain", "same", "like")


class Graph:
    """Tokens of documents and their edges; labels -1 where nothing was observed."""

    def __init__(self) -> None:
        self.tokens: list[tuple[int, int, int]] = []  # document, start, end
        self.shapes: list[tuple[int, ...]] = []
        self.observed: list[int] = []
        self.edges: dict[str, list[tuple[int, int]]] = {name: [] for name in PAIRS}

    def add(self, doc: int, text: str, base: list[Span]) -> None:
        """At most one edge of each kind back from a token, and two of `like`: their number is linear."""
        same, like, last_end, k = {}, {}, -2, 0
        reach: list[Span] = []
        for begin, end in tokens(text):
            here, token = len(self.tokens), text[begin:end]
            while k < len(base) and base[k][0] < end:
                reach.append(base[k])
                k += 1
            reach = [s for s in reach if s[1] > begin]
            self.tokens.append((doc, begin, end))
            head = text[max(0, begin - 40) : begin].rsplit(None, 1)
            self.shapes.append(shape(token, head[-1] if head else ""))
            self.observed.append(1 + KINDS.index(reach[0][2]) if reach else -1)
            if begin == last_end + 1:
                self.edges["chain"].append((here - 1, here))
            core = CORE.sub("", token).lower()
            if len(core) >= 4:
                linked = {same.get(core)}
                if core in same:
                    self.edges["same"].append((same[core], here))
                same[core] = here
                digits = "".join(GROUP.findall(core))
                for key in (("d", digits) if len(digits) >= 6 else None, ("b", core[:8]) if len(core) >= 10 else None):
                    if key:
                        if key in like and like[key] not in linked:
                            self.edges["like"].append((like[key], here))
                            linked.add(like[key])
                        like[key] = here
            last_end = end


class Field:
    """weights: rows of all features, labels; pairs: a matrix for each kind of edge, label of the earlier token first."""

    def __init__(self, shape_weights: np.ndarray, pairs: dict[str, np.ndarray]):
        self.shape_weights, self.pairs = shape_weights, pairs

    def unary(self, graph: Graph) -> np.ndarray:
        unary = self.shape_weights[OFFSETS + np.array(graph.shapes, np.int64).reshape(-1, len(BOUNDS))].sum(1)
        unary -= unary.max(1, keepdims=True)
        seen = np.array(graph.observed)
        unary[seen >= 0] = -20
        unary[seen >= 0, seen[seen >= 0]] = 0
        return unary

    def marginals(self, graph: Graph, rounds: int = 30, damping: float = 0.3) -> np.ndarray:
        """Label probabilities of all tokens by loopy sum-product, edges in parallel, until messages rest."""
        unary = self.unary(graph)
        kinds = [(np.array(graph.edges[name], np.int64).reshape(-1, 2), self.pairs[name]) for name in PAIRS]
        edges = np.concatenate([e for e, _ in kinds])
        if len(edges):
            pair = np.concatenate([np.repeat(m[None], len(e), 0) for e, m in kinds])
            source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
            message = np.zeros((len(source), len(KINDS) + 1))
            back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
            for _ in range(rounds):
                belief = unary.copy()
                np.add.at(belief, target, message)
                out = belief[source] - message[back]
                new = np.logaddexp.reduce(out[:, :, None] + pair, axis=1)
                new -= new.max(1, keepdims=True)
                new = damping * message + (1 - damping) * new
                moved = np.abs(new - message).max()
                message = new
                if moved < 1e-4:
                    break
            np.add.at(unary, target, message)
        unary = np.exp(unary - unary.max(1, keepdims=True))
        return unary / unary.sum(1, keepdims=True)

    def spans(self, texts: list[str], confidence: float = 0.8) -> list[tuple[list[Span], list[Span]]]:
        """Base spans and all spans of each text. Neighbouring tokens of one kind make one span."""
        base = [base_spans(t) for t in texts]
        graph = Graph()
        for i, (text, own) in enumerate(zip(texts, base, strict=True)):
            if ANY.search(text):
                graph.add(i, text, own)
        more: list[list[Span]] = [[] for _ in texts]
        if graph.tokens:
            p = self.marginals(graph)
            best = p.argmax(1)
            for (doc, begin, end), seen, label, sure in zip(graph.tokens, graph.observed, best.tolist(), p.max(1).tolist(), strict=True):
                if seen < 0 and label and sure >= confidence:
                    kind, own = KINDS[label - 1], more[doc]
                    if own and own[-1][2] == kind and own[-1][1] == begin - 1:
                        own[-1] = (own[-1][0], end, kind)
                    else:
                        own.append((begin, end, kind))
        return [(b, sorted(b + [trimmed(t, s) for s in m], key=lambda s: (s[0], KINDS.index(s[2])))) for t, b, m in zip(texts, base, more, strict=True)]


def trimmed(text: str, span: Span) -> Span:
    """Without punctuation on either side."""
    begin, end, kind = span
    while end > begin + 1 and not text[end - 1].isalnum():
        end -= 1
    while begin < end - 1 and not (text[begin].isalnum() or text[begin] == "+"):
        begin += 1
    return begin, end, kind


def instances(graph: Graph) -> Iterator[tuple[int, ...]]:
    """For each token with a known label: its label, the labels of its neighbours (before and after, for each kind of edge; -1
    where there is none) and its shape. A token without a base label counts as none unless a similar one has a label."""
    labels = [max(0, x) for x in graph.observed]
    around = np.full((len(labels), 2 * len(PAIRS)), -1)
    for k, name in enumerate(PAIRS):
        for a, b in graph.edges[name]:
            around[b, 2 * k], around[a, 2 * k + 1] = labels[a], labels[b]
    for y, own, form in zip(labels, around.tolist(), graph.shapes, strict=True):
        if y or max(own[2:]) <= 0:
            yield (y, *own, *form)


def trained(rows: list[tuple[int, ...]], counts: list[int], steps: int = 500) -> Field:
    """All factors by gradient ascent on the pseudo-likelihood of `rows` (see instances), with a quadratic penalty."""
    n_labels, n_around = len(KINDS) + 1, 2 * len(PAIRS)
    w = np.zeros((sum(BOUNDS), n_labels))
    pairs = np.zeros((len(PAIRS), n_labels, n_labels))
    if not rows:
        w[:, 0] = 5.0
        return Field(w, dict(zip(PAIRS, pairs, strict=True)))
    table, n = np.array(rows), np.array(counts, np.float64)
    y, around, keys = table[:, 0], table[:, 1 : 1 + n_around], table[:, 1 + n_around :] + OFFSETS
    # every label weighs alike in the mean of its square root and its count: entities are few
    n = n * np.sqrt(n.sum() / np.maximum(np.bincount(y, n, n_labels), 1e-9))[y]
    n /= n.sum()
    goal = np.eye(n_labels)[y]
    alone, bare = np.full_like(around, -1), np.zeros_like(keys, bool)
    bare[:, :FORM] = True
    views = [(around, np.zeros_like(bare)), (alone, np.zeros_like(bare)), (around, bare)]
    speeds = [np.zeros_like(w), np.zeros_like(pairs)]
    for _ in range(steps):
        pull_w, pull_p = -1e-4 * w, -1e-4 * pairs
        for near, hidden in views:
            z = np.where(hidden[:, :, None], 0, w[keys]).sum(1)
            for k in range(len(PAIRS)):
                before, after = near[:, 2 * k], near[:, 2 * k + 1]
                z += np.where(before[:, None] >= 0, pairs[k][before], 0) + np.where(after[:, None] >= 0, pairs[k][:, after].T, 0)
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (goal - p) * (n / len(views))[:, None]
            np.add.at(pull_w, keys[~hidden], np.repeat(g, (~hidden).sum(1), 0))
            for k in range(len(PAIRS)):
                before, after = near[:, 2 * k], near[:, 2 * k + 1]
                np.add.at(pull_p[k], before[before >= 0], g[before >= 0])
                np.add.at(pull_p[k].T, after[after >= 0], g[after >= 0])
        for value, speed, pull in ((w, speeds[0], pull_w), (pairs, speeds[1], pull_p)):
            speed *= 0.9
            speed += 0.5 * pull
            value += speed
    return Field(w, dict(zip(PAIRS, pairs, strict=True)))


def fit(docs: DataFrame, most_docs: int = 4_000, most_bytes: int = 64 << 20, text: str = "text") -> Field:
    """The field trained on the documents with candidate tokens that have the least hash of doc_id, at most `most_docs` and at most
    `most_bytes` of their texts; a document beyond that alone is passed over. Without any the field labels nothing."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text(text).alias("__text")).filter(F.col("__text").rlike("[0-9@]"))
    sizes = source.filter("doc_id is not null").groupBy("doc_id").agg(F.sum(F.octet_length("__text")).alias("n"))
    first = np.array([tuple(r) for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs).collect()], np.int64).reshape(-1, 2)  # at most most_docs
    fits = first[first[:, 1] <= most_bytes]
    ids = fits[np.cumsum(fits[:, 1]) <= most_bytes, 0].tolist()
    sample = source.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")), "doc_id", "left_semi")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in common.slices(batch, "__text", 8 << 20):
                graph = Graph()
                for i, t in enumerate(part["__text"].to_pylist()):
                    graph.add(i, t, base_spans(t))
                counts.update(instances(graph))
        yield pa.RecordBatch.from_arrays([pa.array(list(map(list, counts)), pa.list_(pa.int32())), pa.array(list(counts.values()), "int64")], ["key", "n"])

    # as many rows as the sample has kinds of tokens in kinds of surroundings
    rows = sorted((tuple(r["key"]), r["n"]) for r in sample.mapInArrow(counted, "key array<int>, n long").groupBy("key").agg(F.sum("n").alias("n")).collect())
    return trained([k for k, _ in rows], [n for _, n in rows])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{begin}:{end}" for begin, end, kind in spans)


def found(docs: DataFrame, field: Field, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of `docs`: the columns `keep`, base and spans (kind:start:end in code points, end exclusive, comma between) and
    the numbers of base spans n_email, n_ip, n_card, n_phone. A null text counts as empty: no spans. Repeated rows stay."""
    source = docs.select(*keep, common.whole_text(text).alias("__text"))
    counts = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "__text", 8 << 20):
                every = field.spans(part["__text"].to_pylist())
                numbers = [pa.array([sum(s[2] == k for s in b) for b, _ in every], "int64") for k in KINDS]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *numbers, pa.array([joined(b) for b, _ in every], "string"), pa.array([joined(s) for _, s in every], "string")], [*part.schema.names[:-1], *counts, "base", "spans"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema[:-1])
    return source.mapInArrow(run, kept + ", ".join(f"{c} long" for c in counts) + ", base string, spans string")


def redacted(docs: DataFrame, field: Field, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """`docs` with every span of `text` replaced by its kind in brackets (overlapping spans by the first one's) and, where there
    is such a column, `length` as the new number of code points. Null texts stay null; all rows and columns stay."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, batch.schema.names[at], 8 << 20):
                texts = part.column(at).to_pylist()
                out = []
                for t, (_, spans) in zip(texts, field.spans([t or "" for t in texts]), strict=True):
                    if spans:
                        pieces, done = [], 0
                        for begin, end, kind in spans:
                            if begin >= done:
                                pieces += [t[done:begin], f"[{kind.upper()}]"]
                            done = max(done, end)
                        t = "".join([*pieces, t[done:]])
                    out.append(t)
                columns = list(part.columns)
                columns[at] = pa.array(out, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)
        common.trimmed()

    clean = docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
    if length in docs.columns:
        kind = docs.schema[length].dataType
        clean = clean.withColumn(length, F.when(F.col(text).isNotNull(), F.char_length(text).cast(kind)).otherwise(F.col(length)))
    return clean


def base_digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()
