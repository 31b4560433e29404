"""SimHash near-duplicates: 64-bit fingerprints of word shingles and their links by bit-sliced comparison.

Distinct fingerprints are compared, so copies cost nothing. For links at few bits the 64 bits are cut into blocks; two fingerprints that
differ in at most `radius` bits agree on all but `radius` of the blocks, so each combination of the other blocks is a
bucket key that finds them (pigeonhole: no link is lost). The number of blocks grows with the number of fingerprints so
that buckets stay small. For links at many bits, where that would need too many keys, the bucket keys are min-hashes of
the shingles: documents of similarity s share one of k with a chance of 1 - (1 - s)^k. The pipeline's stage uses both and checks what is near
by its bits exactly. Inside a bucket the fingerprints' bits stand in vertical planes: 64 candidates share a machine
word, distances are counted for all of them with carry-save adders, and a block of candidates is left as soon as all of
it exceeds the radius. A bucket beyond `TILE` fingerprints is cut into tiles whose pairs are compared in tasks of
their own. A bucket emits only the edges of a spanning forest of its links, so no group is expanded into pairs.

Components: each fingerprint takes the smallest neighbour, in alternating large-star and small-star rounds, until the
edges form stars. Every round is a written table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import file_system

TILE = 8192
#: Buckets of so many fingerprints are compared together.
FEW = 32
#: The same bound where shingle sets are compared.
EXACT_TILE = 2048
#: Sets of similarity 0.8 differ in 9.7 of 64 bits on average, with a deviation of 2.9. Of small sets, where a few shingles decide a
#: bit, a bit differs with a chance of 3/16 at most (four shingles and five), so 12 do with a deviation of 3.1: they have a wider bound.
WIDE = 22
SMALL = 32
SMALL_WIDE = 32
#: So many fingerprints are compared with the planes of a bucket at once.
AT_ONCE = 32
#: Plans of bucket keys from fingerprints are numbered from here, those of min-hashes from 0.
BIT_PLANS = 1 << 16
#: Large buckets are broadcast up to so many.
MOST_BROADCAST = 10_000


def hashes(text: str, words: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle. A-Z are lower-cased, words end at ASCII white space, repeats count; fewer words than a
    shingle are one shingle, no words none."""
    tokens = text.encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]).tolist()
    begins = [0, *ends]
    n = max(1, len(tokens) - words + 1)
    size = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[b : e - 1], seed) for b, e in zip(begins[:n], ends[size - 1 :], strict=False)], np.uint64)


def simhash(text: str, words: int = 4, seed: int = 42) -> int:
    return folded(hashes(text, words, seed))


def folded(own: np.ndarray) -> int:
    """Bit i is 1 if set in over half of the hashes; no hashes give 0."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(own), 65536):
        ones += np.unpackbits(own[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view("<u8")[0])


def least_hashes(own: np.ndarray, k: int) -> list[int]:
    """k min-hashes: the least of the hashes after k multiplications by odd numbers and a shift."""
    if not len(own):
        return [0] * k
    out = []
    for i in range(k):
        mixed = own * np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1) | 1) & 0xFFFFFFFFFFFFFFFF)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        out.append(int((mixed ^ mixed >> np.uint64(32)).min()) - (1 << 63))
    return out


def fingerprints(docs: DataFrame, words: int = 4, text: str = "text", mins: int = 0, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) and mins (so many min-hashes) of each row. A null text counts as empty
    (fingerprint 0); repeated rows stay; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "__text", 2 << 20):
                each = [hashes(t, words, seed) for t in part["__text"].to_pylist()]
                bits = np.array([folded(h) for h in each], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(bits), pa.array([least_hashes(h, mins) for h in each], pa.list_(pa.int64()))], ["doc_id", "fp", "mins"])
        common.trimmed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text(text).alias("__text")).mapInArrow(run, "doc_id long, fp long, mins array<long>")


def blocks_for(n: int, radius: int) -> int:
    """The fewest blocks whose bucket keys have about as many bits as n has, so that a bucket holds few by chance."""
    blocks = radius + 1
    while blocks < 3 * radius and 64 * (blocks - radius) // blocks < n.bit_length() + 2:
        blocks += 1
    return blocks


def planes_of(values: np.ndarray) -> np.ndarray:
    """64 rows: bit i of all values, 64 values a machine word, the last word padded by repeats of the last value."""
    n = -(-len(values) // 64) * 64
    full = np.concatenate([values, np.repeat(values[-1:], n - len(values))]).astype("<u8")
    bits = np.unpackbits(full.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view("<u8")


def near(planes: np.ndarray, value: int | np.ndarray, radius: int, first: int = 0) -> np.ndarray:
    """Machine words whose bits say which values differ from `value` in at most radius bits, from word `first` on. Of several values
    at once, a row each.

    Differences are added plane by plane into bitwise counters (three planes at a time through a carry-save adder);
    `over` gathers the lanes whose count has passed the radius, and the block is left once all have."""
    top = max(1, (radius + 4).bit_length())
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    if isinstance(value, np.ndarray):
        shape = (len(value), planes.shape[1] - first)
        flip = [np.where(value >> np.uint64(i) & np.uint64(1) == 1, full, np.uint64(0))[:, None] for i in range(64)]
    else:
        shape = (planes.shape[1] - first,)
        flip = [full if value >> i & 1 else np.uint64(0) for i in range(64)]
    count = [np.zeros(shape, np.uint64) for _ in range(top)]
    over = np.zeros(shape, np.uint64)

    def add(carry: np.ndarray, at: int) -> None:
        nonlocal over
        for k in range(at, top):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry

    for i in range(0, 63, 3):
        a, b, c = (planes[j, first:] ^ flip[j] for j in (i, i + 1, i + 2))
        half = a ^ b
        add(half ^ c, 0)
        add(a & b | half & c, 1)
        if i % 9 == 6:
            over |= above(count, radius)
            if (over == full).all():
                return np.zeros_like(over)
    add(planes[63, first:] ^ flip[63], 0)
    return ~(over | above(count, radius))


def above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """The lanes whose counter is greater than radius: a bitwise comparison from the highest bit."""
    more, same = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            same = same & count[k]
        else:
            more = more | same & count[k]
            same = same & ~count[k]
    return more


def lanes(hits: np.ndarray) -> Iterator[int]:
    """The numbers of the set bits of machine words."""
    for w in np.flatnonzero(hits).tolist():
        word = int(hits[w])
        while word:
            yield 64 * w + (word & -word).bit_length() - 1
            word &= word - 1


def as_words(flags: np.ndarray, n: int) -> np.ndarray:
    """Flags of lanes as n machine words."""
    packed = np.packbits(flags, bitorder="little")
    return np.concatenate([packed, np.zeros(8 * n - len(packed), np.uint8)]).view("<u8")


def flags_of(words: np.ndarray, n: int) -> np.ndarray:
    """The first n lanes of machine words."""
    return np.unpackbits(words.view(np.uint8), bitorder="little")[:n].astype(bool)


def pair_links(values: np.ndarray, bucket: np.ndarray, size: np.ndarray, radius: int) -> set[tuple[int, int]]:
    """Links inside buckets of few values: `bucket` is where each value's bucket ends, `size` how many it has. The candidate
    pairs of all buckets are the lanes, so small buckets fill machine words too."""
    found = set()
    own = values.view(np.uint64)
    for gap in range(1, int(size.max(initial=1))):
        a = np.flatnonzero(np.arange(len(values)) + gap < bucket)
        for i in range(0, len(a), 1 << 16):
            at = a[i : i + (1 << 16)]
            for lane in lanes(near(planes_of(own[at] ^ own[at + gap]), 0, radius)):
                if lane < len(at):
                    found.add((int(values[at[lane]]), int(values[at[lane] + gap])))
    return found


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links inside `left`, or between `left` and `right` with those inside left known."""
    values = left if right is None else np.concatenate([left, right])
    label, edges = np.arange(len(values)), []
    planes = planes_of((left if right is None else right).view(np.uint64))
    base = 0 if right is None else len(left)
    for i, value in enumerate(left.view(np.uint64).tolist()):
        first = (i + 1) // 64 if right is None else 0
        apart = label[base + 64 * first :] != label[i]  # candidates that are joined already aren't compared
        if right is None:
            apart[: i + 1 - 64 * first] = False
        if not apart.any():
            continue
        hits = near(planes, value, radius, first)
        hits &= as_words(apart, len(hits))
        for j in lanes(hits):
            j += base + 64 * first
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                edges.append((int(values[i]), int(values[j])))
    return edges


def bit_keys(distinct: DataFrame, radius: int) -> DataFrame:
    """Rows with plan and key added: bucket keys at which any two fingerprints (column fp) within the radius meet."""
    blocks = blocks_for(distinct.count(), radius)
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << cuts[b + 1]) - 1) ^ ((1 << cuts[b]) - 1) for b in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return distinct.select("*", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("plan", "key"))


def links(keyed: DataFrame, radius: int = 4) -> DataFrame:
    """Edges a < b with the same components as all links within the radius between fingerprints (plan, key, fp; distinct
    rows) that share a bucket."""
    sizes = keyed.groupBy("plan", "key").agg(F.count("*").alias("n")).filter("n > 1")
    large = common.written(sizes.filter(F.col("n") > TILE), "large")

    def compare(groups: pd.DataFrame) -> pd.DataFrame:
        found: set[tuple[int, int]] = set()
        groups = groups.sort_values(["plan", "key", "fp"], kind="stable")
        fp, plan, key = groups["fp"].to_numpy(), groups["plan"].to_numpy(), groups["key"].to_numpy()
        begins = np.flatnonzero(np.concatenate([[True], (plan[1:] != plan[:-1]) | (key[1:] != key[:-1])]))
        sizes = np.diff(np.append(begins, len(fp)))
        few = np.repeat((sizes > 1) & (sizes <= FEW), sizes)
        if few.any():
            last, size = np.repeat(begins + sizes, sizes), np.repeat(sizes, sizes)
            kept = np.cumsum(few)  # positions among the rows of small buckets
            found |= pair_links(fp[few], kept[last[few] - 1], size[few], radius)
        for a, n in zip(begins.tolist(), sizes.tolist(), strict=True):
            if n > FEW:
                found.update(forest(fp[a : a + n], None, radius))
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    def compare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows come sorted by bucket; the last bucket of a batch may go on in the next
        for batch in batches:
            rows = batch.to_pandas()
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            last = (rows["plan"] == rows["plan"].iloc[-1]) & (rows["key"] == rows["key"].iloc[-1])
            held, rows = rows[last], rows[~last]
            if len(rows):
                yield pa.RecordBatch.from_pandas(compare(rows), preserve_index=False)
        if held is not None:
            yield pa.RecordBatch.from_pandas(compare(held), preserve_index=False)

    small = keyed
    tiles = []
    if not large.isEmpty():
        small = keyed.join(large.select("plan", "key"), ["plan", "key"], "left_anti")
        # tile (i, j), i <= j, of a large bucket compares its parts i and j
        dealt = keyed.join(large, ["plan", "key"]).withColumn("parts", F.ceil(F.col("n") / TILE).cast("int")).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("plan", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "fp")

        def tile(rows: pd.DataFrame) -> pd.DataFrame:
            left, right = (rows["fp"].to_numpy()[rows["part"].to_numpy() == rows[c].iloc[0]] for c in ("i", "j"))
            same = rows["i"].iloc[0] == rows["j"].iloc[0]
            return pd.DataFrame(forest(left, None if same else right, radius) if len(left) and len(right) else [], columns=["a", "b"], dtype="int64")

        tiles.append(pairs.groupBy("plan", "key", "i", "j").applyInPandas(tile, "a long, b long"))
    edges = small.repartition("plan", "key").sortWithinPartitions("plan", "key").mapInArrow(compare_batches, "a long, b long")
    for t in tiles:
        edges = edges.unionByName(t)
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (smallest node reachable) of all nodes of `edges` (a, b), by alternating star rounds."""
    now = common.written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    n = now.count()
    while True:
        # large star: every node links its larger neighbours to its smallest neighbour (or itself)
        both = now.select(F.col("b").alias("u"), F.col("a").alias("v")).unionByName(now.select(F.col("a").alias("u"), F.col("b").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).filter("n > 0").select("u", F.least("u", "m").alias("m"), "n")
        large = common.salted_join(both.filter("v > u"), least, ["u"], "n", n, spread=("v",)).select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # small star: every node links its smaller neighbours and itself to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
        small = common.salted_join(large, least, ["b"], "n", n, spread=("a",)).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a < b").distinct()
        new = common.written(small, "edges")
        # a forest of stars: no node is both a root and a member, no member has two roots
        same = new.agg(F.count("*").alias("n"), F.count_distinct("b").alias("d")).first()
        if same["n"] == same["d"] and new.select("a").distinct().join(new.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break
        common.dropped(now)
        now, n = new, same["n"]
    common.dropped(now)
    return new.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(new.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, text: str = "text", mins: int = 0) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links, itself included) of each row of `docs`.

    Without `mins` fingerprints link at up to `radius` bits, all of them. With `mins` they link at up to `radius` bits if
    they also share one of so many min-hashes of their shingles.

    Null texts count as empty; documents without words have fingerprint 0 and link like any other; repeated rows stay
    and share a component; a null doc_id is never the smallest (a component of nulls alone has null)."""
    each = common.written(fingerprints(docs, words, text, mins), "fingerprints")
    by = common.written(each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    keyed = each.select("fp", F.posexplode("mins").alias("plan", "key")).distinct() if mins else bit_keys(by.select("fp"), radius)
    of = components(links(keyed, radius))
    linked = common.written(by.join(of, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", "root"), "linked")
    several, total = linked.filter("root is not null"), linked.agg(F.count("root").alias("linked"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    roots = several.groupBy("root").agg(F.min("least").alias("smallest"), F.count("*").alias("members"))
    alone = linked.filter("root is null").select("fp", "n", F.col("least").alias("component_id"))  # most rows; a null key would bring them together
    named = common.salted_join(several, roots, ["root"], "members", total["linked"], spread=("fp",)).select("fp", "n", F.col("smallest").alias("component_id")).unionByName(alone)
    return common.salted_join(each, named, ["fp"], "n", total["rows"], spread=("doc_id",)).select("doc_id", "fp", "component_id")


def shingle_sets(docs: DataFrame, words: int, mins: int, text: str) -> DataFrame:
    """doc_id, hash (a row's __hash), node (hash of the set of shingles), fp (fingerprint of the set), size (of the set), mins,
    and shard and offset of the set in a file of the shared folder: sorted shingle hashes of eight bytes."""
    folder = common.scratch(docs.sparkSession, "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, path = None, 0, f"{folder}/{uuid.uuid4().hex}.bin"
        for batch in batches:
            for part in common.slices(batch, "__text", 2 << 20):
                rows = []
                for t in part["__text"].to_pylist():
                    own = np.unique(hashes(t, words, 42))
                    data = own.astype("<u8").tobytes()
                    if out is None:
                        fs, name = file_system(path)
                        fs.create_dir(name.rpartition("/")[0], recursive=True)
                        out = fs.open_output_stream(name)
                    out.write(data)
                    node, bits = (np.array([v], np.uint64).view(np.int64)[0] for v in (xxhash.xxh64_intdigest(data), folded(own)))
                    rows.append((node, bits, len(own), least_hashes(own, mins), path, at))
                    at += len(data)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["__hash"], *(pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "hash", "node", "fp", "size", "mins", "shard", "offset"])
        if out:
            out.close()
        common.trimmed()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__hash"), common.whole_text(text).alias("__text"))
    return source.mapInArrow(run, "doc_id long, hash long, node long, fp long, size int, mins array<long>, shard string, offset long")


class Sets:
    """Shingle sets by range reads; about 32 MB of those read last are held."""

    def __init__(self) -> None:
        self.files, self.held, self.bytes = {}, {}, 0

    def get(self, node: int, shard: str, offset: int, size: int) -> np.ndarray:
        if node not in self.held:
            if self.bytes > 32 << 20:
                self.held.clear()
                self.bytes = 0
            if shard not in self.files:
                if len(self.files) > 100:
                    self.close()
                fs, at = file_system(shard)
                self.files[shard] = fs.open_input_file(at)
            self.held[node] = np.frombuffer(self.files[shard].read_at(8 * size, offset), "<u8")
            self.bytes += 8 * size
        return self.held[node]

    def close(self) -> None:
        for f in self.files.values():
            f.close()
        self.files.clear()


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is `similarity` or more; two empty sets are alike."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= similarity * (len(both) - shared) - 1e-9


class Incidence:
    """Sets as rows of numbers below one bound, so that one set meets all others in a few array operations."""

    #: Hashes held at once; beyond it sets are compared two by two.
    MOST = 4_000_000

    def __init__(self, every: list[np.ndarray]):
        self.size = np.array([len(x) for x in every])
        self.ends = np.cumsum(self.size)
        values, self.ids = np.unique(np.concatenate(every), return_inverse=True)
        self.flags = np.zeros(len(values), np.uint8)

    def shared(self, i: int) -> np.ndarray:
        """How many elements set i has in common with each."""
        own = self.ids[self.ends[i] - self.size[i] : self.ends[i]]
        self.flags[own] = 1
        sums = np.concatenate([[0], np.cumsum(self.flags[self.ids], dtype=np.int64)])
        self.flags[own] = 0
        return sums[self.ends] - sums[self.ends - self.size]


def sizes_allow(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    return np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9


class Forest:
    """Components of the nodes linked so far."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, node: int) -> int:
        while (up := self.parent.get(node, node)) != node:
            self.parent[node] = node = self.parent.get(up, up)
        return node

    def joined(self, a: int, b: int) -> bool:
        return self.root(a) == self.root(b)

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple[int, int]]:
        """Each node that isn't the smallest of its component, beside the smallest."""
        return [(r, n) for n in list(self.parent) if (r := self.root(n)) != n]


def few_edges(rows: pd.DataFrame, ends: np.ndarray, similarity: float, radius: int, sets: Sets, known: Forest) -> None:
    """Links inside buckets of few sets go to `known`; `ends` is where each row's bucket ends. The candidate pairs of all buckets are the lanes,
    so small buckets fill machine words too. Pairs near by their bits are compared unless they are joined already or, in a bucket of
    fingerprints' bits (whose rows have mins), meet at a min-hash as well."""
    node, fp, size = rows["node"].to_numpy(), rows["fp"].to_numpy().view(np.uint64), rows["size"].to_numpy()
    shard, offset = rows["shard"].to_numpy(), rows["offset"].to_numpy()
    here, mins = np.arange(len(node)), rows["mins"].to_numpy() if "mins" in rows else np.full(len(node), None)
    for gap in range(1, int((ends - here).max(initial=1))):
        all_pairs = np.flatnonzero(here + gap < ends)
        for k in range(0, len(all_pairs), 1 << 16):
            i = all_pairs[k : k + (1 << 16)]
            j = i + gap
            planes, small = planes_of(fp[i] ^ fp[j]), np.minimum(size[i], size[j]) <= SMALL
            hits = near(planes, 0, radius)
            if radius < SMALL_WIDE and small.any():
                hits |= near(planes, 0, SMALL_WIDE) & as_words(small, len(hits))
            at = flags_of(hits, len(i)) & sizes_allow(size[i], size[j], similarity)
            for a, b in zip(i[at].tolist(), j[at].tolist(), strict=True):
                if not known.joined(int(node[a]), int(node[b])) and (mins[a] is None or not (mins[a] == mins[b]).any()) and alike(*(sets.get(int(node[x]), shard[x], int(offset[x]), int(size[x])) for x in (a, b)), similarity):
                    known.join(int(node[a]), int(node[b]))


def exact_edges(rows: pd.DataFrame, cut: int, similarity: float, radius: int, sets: Sets) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links in a bucket. Fingerprints are compared in bit planes; those within `radius` bits (SMALL_WIDE
    of a set up to SMALL) whose sizes allow the similarity are candidates. With `cut` only pairs of the first `cut` rows with the others
    count. Pairs already joined are not compared, nor are those of a bucket of fingerprints' bits (whose rows have mins) that meet at a min-hash. A set with many candidates meets them all at once."""
    node, fp, size = rows["node"].to_numpy(), rows["fp"].to_numpy().view(np.uint64), rows["size"].to_numpy()
    shard, offset = rows["shard"].to_numpy(), rows["offset"].to_numpy()
    label, edges = np.arange(len(node)), []
    enough, incidence = int(size.sum(dtype=np.int64)) <= Incidence.MOST, None
    planes, rows_in = planes_of(fp[cut:]), cut or len(node)
    mins = np.stack(rows["mins"].to_list()) if "mins" in rows and rows["mins"].iloc[0] is not None else None

    def of(k: int) -> np.ndarray:
        return sets.get(int(node[k]), shard[k], int(offset[k]), int(size[k]))

    for i in range(rows_in):
        if i % AT_ONCE == 0:
            word, hits, wider = 0 if cut else (i + 1) // 64, None, None
            values, begin = fp[i : min(i + AT_ONCE, rows_in)], cut + 64 * word
        allowed = (label[begin:] != label[i]) & sizes_allow(size[begin:], size[i], similarity)
        if not cut:
            allowed[: i + 1 - begin] = False
        if mins is not None and allowed.any():
            allowed &= ~(mins[begin:] == mins[i]).any(1)  # they meet at a min-hash as well
        if not allowed.any():
            continue
        hits = near(planes, values, radius, word) if hits is None else hits
        close, small = flags_of(hits[i % AT_ONCE], len(allowed)), np.minimum(size[begin:], size[i]) <= SMALL
        if radius < SMALL_WIDE and (small & allowed).any():
            wider = near(planes, values, SMALL_WIDE, word) if wider is None else wider
            close |= flags_of(wider[i % AT_ONCE], len(allowed)) & small
        at = begin + np.flatnonzero(close & allowed)
        if len(at) >= 16 and enough:
            incidence = incidence or Incidence([of(k) for k in range(len(node))])
            shared = incidence.shared(i)[at]
            at = at[shared >= similarity * (size[at] + size[i] - shared) - 1e-9]
            linked = at.tolist()
        else:
            linked = (j for j in at.tolist() if label[i] != label[j] and alike(of(i), of(j), similarity))
        for j in linked:
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                edges.append((int(node[i]), int(node[j])))
    return edges


def close_fingerprints(each: DataFrame, few: int) -> DataFrame:
    """Bucket keys at which sets meet whose fingerprints differ in at most `few` bits, of the sets that have such a partner. Their rows have mins."""
    by = common.written(each.groupBy("fp").agg(F.count("*").alias("n")), "fingerprints")
    ends = links(bit_keys(by.select("fp"), few), few).select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    partners = by.join(ends.withColumn("linked", F.lit(True)), "fp", "left").filter("n > 1 or linked").select("fp", "n")
    total = by.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    close = common.written(common.salted_join(each, partners, ["fp"], "n", total, spread=("node",), counts=by).select("node", "fp", "size", "shard", "offset", "mins"), "close")
    return bit_keys(close, few).withColumn("plan", F.col("plan") + BIT_PLANS)


def exact_links(each: DataFrame, similarity: float, radius: int, few: int = 4) -> DataFrame:
    """Edges a < b with the same components as all pairs of shingle sets of Jaccard similarity `similarity` or more whose fingerprints differ in at
    most `few` bits, or in at most `radius` bits (SMALL_WIDE of small sets) where they also share a min-hash. `each`: one row a node, as
    from shingle_sets."""
    columns = ["node", "fp", "size", "shard", "offset"]
    keyed = close_fingerprints(each, few).unionByName(each.select(*columns, F.posexplode("mins").alias("plan", "key")), allowMissingColumns=True)
    sizes = keyed.groupBy("plan", "key").agg(F.count("*").alias("n")).filter("n > 1")
    large = common.written(sizes.filter(F.col("n") > EXACT_TILE), "large")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sets = None, Sets()  # rows come sorted by bucket; the last bucket of a batch may go on in the next

        def edges(rows: pd.DataFrame) -> pa.RecordBatch:
            plan, key = rows["plan"].to_numpy(), rows["key"].to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], (plan[1:] != plan[:-1]) | (key[1:] != key[:-1])]))
            n = np.diff(np.append(begins, len(rows)))
            known, few_rows = Forest(), np.repeat((n > 1) & (n <= FEW), n)
            if few_rows.any():
                kept = np.cumsum(few_rows)  # positions among the rows of small buckets
                few_edges(rows[few_rows], kept[np.repeat(begins + n, n)[few_rows] - 1], similarity, radius, sets, known)
            for b, m in zip(begins[n > FEW].tolist(), n[n > FEW].tolist(), strict=True):
                for edge in exact_edges(rows.iloc[b : b + m], 0, similarity, radius, sets):
                    known.join(*edge)
            return pa.RecordBatch.from_pandas(pd.DataFrame(sorted(known.stars()), columns=["a", "b"], dtype="int64"), preserve_index=False)

        for batch in batches:
            rows = batch.to_pandas()
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            last = (rows["plan"] == rows["plan"].iloc[-1]) & (rows["key"] == rows["key"].iloc[-1])
            held, rows = rows[last], rows[~last]
            if len(rows):
                yield edges(rows)
        if held is not None:
            yield edges(held)
        sets.close()
        common.trimmed()

    small, tiles = keyed, None
    if not large.isEmpty():
        few = large.count() <= MOST_BROADCAST
        small = keyed.join(F.broadcast(large.select("plan", "key")), ["plan", "key"], "left_anti") if few else keyed.join(sizes.filter(F.col("n") <= EXACT_TILE).select("plan", "key"), ["plan", "key"], "left_semi")
        # tile (i, j), i <= j, of a large bucket compares its parts i and j
        sized = large.withColumn("__of", F.col("n"))
        dealt = keyed.join(F.broadcast(large), ["plan", "key"]) if few else common.salted_join(keyed, sized, ["plan", "key"], "n", keyed.count(), spread=("node",)).withColumnRenamed("__of", "n")
        dealt = dealt.withColumn("parts", F.ceil(F.col("n") / EXACT_TILE).cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("n", "parts", "other")

        def tile(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["part", "node"], kind="stable", ignore_index=True)
            left = int((rows["part"] == rows["i"]).sum())
            same, sets = rows["i"].iloc[0] == rows["j"].iloc[0], Sets()
            found = exact_edges(rows, 0 if same else left, similarity, radius, sets) if same or 0 < left < len(rows) else []
            sets.close()
            return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

        tiles = pairs.groupBy("plan", "key", "i", "j").applyInPandas(tile, "a long, b long")
    edges = small.repartition("plan", "key").sortWithinPartitions("plan", "key").mapInArrow(compare, "a long, b long")
    edges = edges if tiles is None else edges.unionByName(tiles)
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def exact_components(docs: DataFrame, words: int, similarity: float, mins: int, text: str) -> DataFrame:
    """doc_id, hash and component of each row of `docs` (which has a column __hash), over links of the shingle sets."""
    each = common.written(shingle_sets(docs, words, mins, text), "sets")
    one = common.written(each.groupBy("node").agg(F.min(F.struct("shard", "offset", "fp", "size", "mins")).alias("at"), F.count("*").alias("n")).select("node", "n", "at.*"), "distinct")
    of = components(exact_links(one, similarity, WIDE))
    named = one.join(of, "node", "left").select("node", "n", F.coalesce("root", "node").alias("component"))
    return common.salted_join(each.select("doc_id", "hash", "node"), named, ["node"], "n", each.count(), spread=("doc_id",), counts=one.select("node", "n")).select("doc_id", "hash", "component")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, mins: int = 8, text: str = "text") -> DataFrame:
    """`docs` with one document of each near-duplicate component: the one with the smallest doc_id.

    Fingerprints of the sets of shingles meet in buckets and are compared in bit planes: pairs within 4 bits are all found (pigeonhole), those within
    WIDE bits (SMALL_WIDE of sets up to SMALL) if they also share one of `mins` min-hashes. An exact check follows: what is near by its bits links
    if the Jaccard similarity of the sets is at least `similarity`. A pair of similarity 0.8 shares a min-hash with a chance of 0.999997
    at any size; the bits lose fewer than one in 10^4 beyond SMALL. A null doc_id tells nothing, so rows with one
    aren't dropped for a document that has an id: of each component one row with an id stays (of the smallest doc_id, then
    of the least row hash) and one without."""
    kinds = dict(docs.dtypes)
    plain = [F.col(f"`{c}`") for c in docs.columns if not kinds[c].startswith(("map", "variant", "void"))]
    keyed = docs.withColumn("__hash", F.xxhash64(*plain, *[c.isNull() for c in plain]))  # nulls don't change xxhash64 alone
    of = common.written(exact_components(keyed, words, similarity, mins, text), "components")
    first = of.groupBy("component", F.col("doc_id").isNull().alias("__none")).agg(F.min(F.struct("doc_id", "hash")).alias("first")).select(F.col("first.hash").alias("__hash")).distinct()
    equal = of.groupBy(F.col("hash").alias("__hash")).agg(F.count("*").alias("n"))  # rows of a hash are equal
    chosen = common.written(first.join(equal, "__hash").withColumn("__many", F.col("n") > 1), "chosen")
    kept = common.salted_join(keyed, chosen, ["__hash"], "n", of.count())
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # of equal rows one stays; they are put together before they move
    return kept.filter("not __many").select(*columns).unionByName(kept.filter("__many").dropDuplicates(["__hash"]).select(*columns))
