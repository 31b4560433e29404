from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import EDGE, SCHEMA, edge, empty, prose
from tracemill.llm import digest, media, simhash


def brute_fingerprint(text, n):
    words = bytes(text, "utf-8").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", ["", "a", "A b  C\tD", "a b c d e f", "É é Ü x"])
def test_simhash(text):
    assert simhash.simhash(text, 4) == brute_fingerprint(text, 4)


def cloud(n, seed=0):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**63, n).astype(np.uint64)
    moved = [b ^ np.uint64(sum(1 << int(k) for k in r.choice(64, int(r.integers(0, 7)), replace=False))) for b in base for _ in range(3)]
    return np.unique(np.concatenate([base, np.array(moved, np.uint64)])).view(np.int64)


def linked(values, radius):
    own = values.view(np.uint64)
    far = np.bitwise_count(own[:, None] ^ own[None, :])
    return {(int(values[i]), int(values[j])) for i, j in zip(*np.nonzero(np.triu(far <= radius, 1)), strict=True)}


@pytest.mark.parametrize("radius", [0, 3, 4, 12])
def test_bit_sliced_forest(radius):
    v = cloud(120)
    want = roots(v.tolist(), linked(v, radius))
    assert roots(v.tolist(), simhash.forest(v, None, radius)) == want
    a, b = v[:200], v[200:]
    assert roots(v.tolist(), [*simhash.forest(a, None, radius), *simhash.forest(b, None, radius), *simhash.forest(a, b, radius)]) == want
    assert simhash.pair_links(v, np.full(len(v), len(v)), np.full(len(v), len(v)), radius) == linked(v, radius)


@pytest.mark.parametrize("tile", [8192, 20])
def test_links_lose_nothing(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    v = np.concatenate([cloud(100, 3), np.arange(0, 300, 3)])
    df = spark.createDataFrame([(int(x),) for x in np.unique(v)], "fp long")
    edges = [(r["a"], r["b"]) for r in simhash.links(simhash.bit_keys(df, 4), 4).collect()]
    assert roots(np.unique(v).tolist(), edges) == roots(np.unique(v).tolist(), linked(np.unique(v), 4))


def test_near_duplicates(spark):
    rng = random.Random(4)
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(prose(60))]
    for k, (_, t, *rest) in enumerate(rows[:20]):
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((1000 + k, " ".join(w), *rest))
    rows += [(d if d is None else 2000 + d, *r) for d, *r in EDGE]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    fps = [(d, brute_fingerprint(t or "", 4)) for d, t, *_ in rows]
    comp = roots({f for _, f in fps}, [(a, b) for a in {f for _, f in fps} for b in {f for _, f in fps} if a < b and (a ^ b).bit_count() <= 4])
    least = {}
    for d, f in fps:
        if d is not None:
            least[comp[f]] = min(least.get(comp[f], d), d)
    want = sorted((d or -1, f, least.get(comp[f])) for d, f in fps)
    assert sorted((r["doc_id"] or -1, r["fp"] % (1 << 64), r["component_id"]) for r in got) == sorted((d if d != 0 else -1, *r) for d, *r in want)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_one_of_each(spark):
    base = prose(30, 9)
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(base)] + [(100 + i, t, "de", "b", 2) for i, t in enumerate(base[:10])] + [(5, base[5], "en", "a", 1), (None, base[0], "en", "a", 1)]
    long = " ".join(prose(20, 11))
    rows += [(200, long, "en", "a", 1), (201, long.replace(long.split()[50], "other", 1), "en", "a", 1)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, i) for i in [*range(30), 200]] + [(True, None)]
    assert simhash.one_of_each(empty(spark)).count() == 0


@pytest.mark.parametrize("tile", [2048, 40])
def test_one_of_each_links_by_jaccard(spark, tile, monkeypatch):
    """Links of the near-duplicate stage against brute-force Jaccard of five-word shingles: no false and no lost ones."""
    monkeypatch.setattr(simhash, "EXACT_TILE", tile)
    rng = random.Random(7)
    texts = []
    for n in (100, 100, 100, 300, 300):  # families whose members share all but a run of words at the end
        stem = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        for keep in (1.0, 0.95, 0.92, 0.9, 0.88, 0.85, 0.8, 0.75, 0.7, 0.6, 0.5):
            k = int(n * keep)
            texts.append(" ".join(stem[:k] + [f"x{rng.randrange(10**9)}" for _ in range(n - k)]))
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    want = roots(range(len(texts)), [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    assert {r["doc_id"] for r in simhash.one_of_each(docs).collect()} == set(want.values())
    assert len(texts) > len(set(want.values())) > 5


@pytest.mark.parametrize("tile", [2048, 3])
def test_one_of_each_finds_by_fingerprints(spark, tile, monkeypatch):
    """Near copies within few bits are found by their fingerprints alone, without a common min-hash, and then checked exactly."""
    monkeypatch.setattr(simhash, "EXACT_TILE", tile)
    base = [" ".join(f"w{d}x{i}" for i in range(400)) for d in range(6)]
    copies = [f"{t} end{k}" for t in base[:4] for k in range(3)]
    prints = [simhash.folded(np.unique(simhash.hashes(t, 5, 42))) for t in base + copies]
    assert all((prints[d] ^ prints[6 + 3 * d + k]).bit_count() <= 4 for d in range(4) for k in range(3))
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(base + copies)], SCHEMA)
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs, mins=0).collect()) == list(range(6))
    assert simhash.one_of_each(docs, similarity=0.9999, mins=0).count() == len(base + copies)


@pytest.mark.parametrize("cut", [0, 70])
def test_bits_decide_what_is_compared(tmp_path, cut):
    """Of large sets only those within the radius are compared, of small ones those within the wider one."""
    import pandas as pd

    own = np.arange(1, 41, dtype="<u8")
    (tmp_path / "s").write_bytes(own.tobytes())
    for size, bits, links in ((40, 22, True), (40, 23, False), (20, 32, True), (20, 33, False)):
        far = [(1 << bits) - 1 if k >= 70 else 0 for k in range(140)]
        df = pd.DataFrame([(k, far[k], size, str(tmp_path / "s"), 0) for k in range(140)], columns=["node", "fp", "size", "shard", "offset"])
        sets = simhash.Sets()
        edges = simhash.exact_edges(df, cut, 0.8, simhash.WIDE, sets)
        known = simhash.Forest()
        simhash.few_edges(df[69:71], np.array([2, 2]), 0.8, simhash.WIDE, sets, known)
        sets.close()
        assert any((a < 70) != (b < 70) for a, b in edges) == links == bool(known.stars())


def test_sets_meet_all_at_once(tmp_path, monkeypatch):
    """The forest is the same whether a set meets its candidates at once or one by one."""
    import pandas as pd

    rng, data, rows = np.random.default_rng(6), b"", []
    base = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    for k in range(150):
        own = base.copy()
        own[rng.choice(len(own), int(rng.integers(0, 60)), replace=False)] ^= np.uint64(1 + k)
        own = np.unique(own)
        rows.append((k, 0, len(own), str(tmp_path / "s"), len(data)))
        data += own.astype("<u8").tobytes()
    (tmp_path / "s").write_bytes(data)
    df = pd.DataFrame(rows, columns=["node", "fp", "size", "shard", "offset"])
    found = []
    for most in (10**9, 0):
        monkeypatch.setattr(simhash.Incidence, "MOST", most)
        sets = simhash.Sets()
        found.append([roots(range(150), simhash.exact_edges(df, cut, 0.8, 64, sets)) for cut in (0, 70)])
        sets.close()
    assert found[0] == found[1] and 5 < len(set(found[0][0].values())) < 145


def test_one_of_each_keys_by_row(spark):
    """An id met with different texts loses none of them, and copies among rows without an id go."""
    a, b, c = prose(3, 21)
    rows = [(1, a, "en", "a", 1), (1, b, "en", "a", 1), (2, b, "en", "a", 1), (1, a, "en", "a", 1), (None, c, "en", "a", 1), (None, c, "en", "a", 1), (None, c, "de", "b", 2), (None, None, "x", "a", 1), (None, "x", None, "a", 1)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted([(1, a), (1, b), (None, c), (None, None), (None, "x")], key=repr)


def test_canonical():
    assert digest.canonical("  The\tQUICK \n fox ") == b"the quick fox"
    assert digest.canonical("ﬁne Straße") == digest.canonical("FINE STRASSE")


@pytest.mark.parametrize("per_range", [3, 1000])
def test_neighbours(spark, per_range, monkeypatch):
    docs = edge(spark)
    monkeypatch.setattr(digest, "neighbours", lambda d, text="text", f=digest.neighbours: f(d, per_range, text=text))
    got = digest.fingerprinted(docs).collect()
    order = sorted(EDGE, key=lambda r: (r[0] if r[0] is not None else -1, np.uint64(xxhash.xxh64_intdigest(r[1] or "", 42)).astype(np.int64)), reverse=True)
    want = []
    for i, (d, t, *_) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        e = t[: len(t) - k] + n[:k]
        want.append((d or 0, len(t), hashlib.sha256(e.encode()).hexdigest(), xxhash.xxh3_128_hexdigest(digest.canonical(t)), xxhash.xxh3_128_hexdigest(digest.canonical(e)), float(digest.canonical(t) == digest.canonical(e)), float(digest.canonical(t) == digest.canonical(n))))
    assert sorted((r[0] or 0, *r[1:]) for r in got) == sorted(want)


def test_digest_collisions_are_told_apart(spark, monkeypatch):
    proofs = spark.createDataFrame([(1, "f", b"a"), (2, "f", b"a"), (3, "f", b"b")], "doc_id long, fp string, proof binary")
    assert [(r["doc_id"], r["own"]) for r in digest.collisions(proofs).collect()] == [(3, hashlib.sha256(b"b").hexdigest())]
    assert digest.fingerprinted(empty(spark)).count() == 0


def test_media(spark):
    index = media.store(edge(spark))
    got = media.read_back(index).collect()
    want = []
    for d, t, *_ in EDGE:
        p = media.padded(t or "")
        assert len(p) % 576 == 0 and len(p)
        s = media.picture(p)
        assert media.samples(s) == p
        want.append((d or 0, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(s), hashlib.sha256(s).hexdigest(), media.feature(p)))
    assert sorted((r[0] or 0, *r[1:8]) for r in got) == sorted(want)
    assert all((r["width"], r["height"], r["bits"], r["digest"]) == (576, r["payload_bytes"] // 576, 8, r["media_sha256"]) for r in got)
    heads = media.metadata(index).collect()
    assert all(r["width"] == 576 and r["bits"] == 8 for r in heads) and {r["height"] for r in heads} >= {1, len(media.padded("x" * 50000)) // 576}
    shard = index.first()["shard"]
    fs, at = media.file_system(shard)
    names = media.members(fs.open_input_file(at).read())
    assert len(names) == len(set(names))
    assert media.store(empty(spark)).count() == 0 and media.read_back(media.store(empty(spark))).count() == 0


def test_media_addresses(spark):
    """A content has one address, whichever tasks met it, and it is read in several tasks."""
    texts = prose(40)
    docs = spark.createDataFrame([(i, texts[i % 40 if i % 3 else 0]) for i in range(400)], "doc_id long, text string").repartition(5, "doc_id")
    index = media.store(docs)
    rows = index.collect()
    assert len(rows) == 400 and len({r["digest"] for r in rows}) == len({tuple(r[1:]) for r in rows}) == 40
    assert {r["doc_id"]: r["payload_sha256"] for r in media.read_back(index).collect()} == {i: hashlib.sha256(media.padded(texts[i % 40 if i % 3 else 0])).hexdigest() for i in range(400)}


def test_written_tables_go(spark):
    """Tables of a round go with it, and all others when the application sweeps."""
    from pathlib import Path

    from tracemill.llm import common

    chain = spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long")
    assert {(r["node"], r["root"]) for r in simhash.components(chain).collect()} == {(i, 0) for i in range(13)}
    folder = Path(common.scratch(spark, "x").removeprefix("file://")).parent
    assert len(list(folder.glob("edges-*"))) >= 1
    mine = common.written(chain, "mine")
    common.dropped(mine)
    assert not list(folder.glob("mine-*"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(type("S", (), {"conf": {}, "sparkContext": type("C", (), {"master": "spark://x"})})())
    common.swept(spark)
    assert not folder.exists()
