"""Language masks, conversation repair and filter interactions against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tracemill.llm import convrepair, interactions, langmask

from .helpers import EDGE, SCHEMA, edge, empty

SPACES = " \t\n\x0b\x0c\r"
CONV = "conv_id long, turn long, role string, text string"


# --- filter interactions


def plain_interactions(docs, labels):
    rows, out = [], {}
    for doc, text, _, source, _ in docs:
        t = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        copy = doc is not None and any(d is not None and d < doc and (o or "") == t for d, o, *_ in docs)
        f = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), copy)
        own = [(q, x) for i, q, x in labels if i == doc and doc is not None]
        rows.append((source or "", dict(zip("ABCDE", f, strict=True)), any(q == 1 for q, _ in own), any(x == 1 for _, x in own)))
    shapley = {}
    for order in permutations("ABCDE"):
        for part, f, good, toxic in rows:
            gone = False
            for step, name in enumerate(order, 1):
                c = out.setdefault((part, "".join(order), step), [0] * 6)
                shapley.setdefault((part, name), 0)
                if f[name]:
                    if gone:
                        c[2] += 1
                    else:
                        c[1] += 1
                        c[4] += good
                        c[5] += toxic
                        shapley[part, name] += 1
                    c[3] += sum(f.values()) == 1
                    gone = True
                c[0] += not gone
    return sorted((p, o, s, *c, shapley[p, o[s - 1]]) for (p, o, s), c in out.items())


def test_interactions_of_edge_rows(spark):
    rng = random.Random(3)
    docs = list(EDGE)
    for i in range(20, 60):
        docs.append((i, " ".join(rng.choice(["a", "B", "c#", "dd", "E"]) for _ in range(rng.choice([3, 60, 90]))), "en", rng.choice(["p", None, ""]), 1))
    docs += [(70 + i, docs[20 + i % 3][1], "en", "p", 1) for i in range(9)] + [(None, docs[20][1], "en", "p", 1)]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 80, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1), (24, None, 1)]
    df = spark.createDataFrame(docs, SCHEMA).withColumn("fails", F.lit("x")).withColumn("part", F.lit(1)).withColumn("copy", F.lit(1)).withColumn("n", F.lit(1))
    got = interactions.interactions(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("lone", F.lit("x")))
    assert sorted(map(tuple, got.collect())) == plain_interactions(docs, labels)


def test_interactions_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.interactions(empty(spark), none).count() == 0
    assert interactions.interactions(edge(spark), none).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_interactions_of_frequent_copies(spark):
    docs = [(i, "same text" if i % 3 else f"text {i}", "en", "hot", 1) for i in range(1500)]
    got = interactions.interactions(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    first = got.filter("filter_order = 'EABCD' and step = 1").first()
    assert (first["removed"], first["kept"], first["redundant"]) == (999, 501, 0)


# --- conversations


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def best_edits(marks):
    """Cheapest, then least edits by enumeration over (row, state); marks: (initial, must go, cut)."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def solve(i, state, inserted):
        found = []
        if i == len(marks):
            if state in ("", "a"):
                found.append((0, ""))
        else:
            initial, gone, cut = marks[i]
            c, e = solve(i + 1, state, 0)
            found.append((c + 4, "D" + e))
            if not gone:
                if (state, initial) in after:
                    c, e = solve(i + 1, after[state, initial], 0)
                    found.append((c + 3 * cut, "K" + e))
                for r in "ua":
                    if (state, r) in after:
                        c, e = solve(i + 1, r, 0)
                        found.append((c + 3 + 3 * cut, "R" + e))
        if inserted < 3:
            for r in "ua":
                if (state, r) in after:
                    c, e = solve(i, r, inserted + 1)
                    found.append((c + 3, "I" + e))
        return min(found, default=(10**9, ""))

    return solve(0, "", 0)


def plain_repair(rows):
    result = {}
    for conv, own in plain_damage(rows).items():
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{'' if conv is None else conv}:{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()))
        seen, marks, counts = set(), [], [0, 0, 0]
        for _, role, text in own:
            bare = text.rstrip(SPACES)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            marks.append((role[:1], fault in (0, 1), fault == 2))
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit = best_edits(tuple(marks))
        out, at, state = [], 0, ""
        for e in audit:
            if e == "D":
                at += 1
                continue
            if e == "K":
                role, text = own[at][1:]
            else:
                role, text = "assistant" if state == "u" else "user", own[at][2] if e == "R" else ""
            at += e != "I"
            state = role[0]
            out.append(f"{role}:{text}")
        result[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    return result


def repair(spark, rows):
    df = spark.createDataFrame(rows, CONV)
    for name in ("kind", "digest", "signature", "n", "copies"):
        df = df.withColumn(name, F.lit("x"))
    got = convrepair.audited(convrepair.damaged(df), df).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    assert len(got) == len({r["conv_id"] for r in got})
    return {r[0]: tuple(r[1:]) for r in got}


def conversations(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(["Yes.", "No", "what? ", " \n", "", None, "é!", "Fine.\x0b", "a.b"])))
    return rows + rows[::17]


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_against_enumeration(spark, seed):
    rows = conversations(seed)
    assert repair(spark, rows) == plain_repair(rows)


def test_repair_of_one_very_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(convrepair, "PIECE", 64)
    rng = random.Random(5)
    rows = [(7, i // 3, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", f"No {i}", f"{i}!"])) for i in range(700)] + [(8, 0, "user", "Hi.")] + [(9, 5, "user", "Same.")] * 400
    assert repair(spark, rows) == plain_repair(rows)


def test_signatures_of_every_kind_are_solved_like_the_plain_ones():
    rng, solver = random.Random(9), convrepair.Solver(most=500)
    for _ in range(2000):
        s = "".join(rng.choices(convrepair.SYMBOLS, k=rng.randint(0, 9)))
        marks = tuple(("suao"[i % 4], i >= 8, 4 <= i < 8) for i in map(convrepair.SYMBOLS.index, s))
        assert solver.solve(s)[-2:] == best_edits(marks), s


def test_repair_of_nothing(spark):
    assert repair(spark, []) == {}
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    assert repair(spark, [(gone, 1, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_stayed_rows_are_returned(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", 1), (1, 1, "tool", "b.", 1)], CONV + ", copies int")
    audits = spark.createDataFrame([(1, "KR"), (2, "II")], "conv_id long, audit string")
    assert sorted(map(tuple, convrepair.repaired(df, audits).collect())) == [(1, "K", "user", "a"), (1, "R", "assistant", "b."), (2, "I", "assistant", ""), (2, "I", "user", "")]


# --- languages

LANGS = {"xx": "the ing tion er on wh sh", "yy": "ung sch keit über ver ein", "zz": "ção ñe ll rr está que"}


def spoken(lang, rng, n):
    return " ".join("".join(rng.choices(LANGS[lang].split(), k=rng.randint(1, 3))) for _ in range(n))


def held_docs(n, seed=1):
    rng = random.Random(seed)
    return [(i, spoken(lang := rng.choice(sorted(LANGS)), rng, rng.randint(3, 80)), lang, "s", 1) for i in range(n)]


def test_languages_on_held_out_rows(spark):
    docs = held_docs(600)
    df = spark.createDataFrame(docs, SCHEMA)
    model = langmask.fit(df)
    assert sorted(model.names) == sorted(LANGS) and (model.wrong < 0.02).all()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langmask.identified(df, model).collect()}
    held = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 5 == 0]
    assert len(held) > 50 and sum(got[i][0] == lang for i, _, lang, *_ in held) >= 0.98 * len(held)
    assert all(0 <= s <= 1 for _, s in got.values())


def test_filters_hold_what_was_learned_and_counts_are_plain(spark):
    docs = held_docs(200, 2)
    model = langmask.fit(spark.createDataFrame(docs, SCHEMA), least=1, share=0.0)
    learned = {k: set() for k in model.names}
    for i, t, lang, *_ in docs:
        if zlib.crc32(str(i).encode()) % 5:
            learned[lang] |= plain_grams(t)
    texts = [d[1] for d in docs[:40]]
    hits, every, _ = model.counts(texts)
    for t, own, n in zip(texts, hits, every, strict=True):
        grams = [g for size in langmask.SIZES for g in all_grams(t, size)]
        assert n == len(grams)
        for name, k in zip(model.names, own, strict=True):
            known = sum(g in learned[name] for g in grams)
            assert known <= k <= known + 0.1 * n + 3  # false positives only


def all_grams(text, size):
    s = " " + re.sub(r"\W+", " ", text.lower()).strip() + " "
    return [s[i : i + size] for i in range(len(s) - size + 1) if " " not in s[i + 1 : i + size - 1]]


def plain_grams(text):
    return {g for size in langmask.SIZES for g in all_grams(text, size)}


def test_long_texts_pass_in_windows(spark, monkeypatch):
    model = langmask.fit(spark.createDataFrame(held_docs(200), SCHEMA))
    texts = [d[1] for d in held_docs(60, 4)] + ["", "x" * 500, "12 34"]
    whole = model.counts(texts)
    monkeypatch.setattr(langmask, "WINDOW", 37)
    assert all((a == b).all() for a, b in zip(whole, model.counts(texts), strict=True))


def test_languages_of_edge_rows(spark):
    df = edge(spark).unionByName(spark.createDataFrame([(d[0] + 1000, *d[1:]) for d in held_docs(80)], SCHEMA), allowMissingColumns=True)
    rows = [tuple(r) for r in langmask.identified(df, langmask.fit(df)).collect()]
    assert len(rows) == len(EDGE) + 80
    by = {r[0]: r for r in rows}
    assert all(by[i][1:] == ("und", 0.0) for i in (3, 4, 5)) and by[7][1] != "und" and by[None][1] != "und"
    none = langmask.fit(edge(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langmask.identified(edge(spark), none).collect()} == {"und"}
    assert langmask.identified(empty(spark), langmask.fit(empty(spark))).count() == 0


def test_more_than_64_languages(spark):
    docs = [(i, " ".join(f"{chr(97 + k // 26)}{chr(97 + k % 26)}{c}q" for c in "abcdef"), f"l{k:03d}", "s", 1) for i, k in ((i, i % 90) for i in range(2000))]
    df = spark.createDataFrame(docs, SCHEMA)
    model = langmask.fit(df)
    assert len(model.table) == 2 and len(model.names) == 90
    got = {r["doc_id"]: r["lang_pred"] for r in langmask.identified(df, model).collect()}
    assert sum(got[d[0]] == d[2] for d in docs) >= 0.99 * len(docs)


# --- bounds of samples


def test_a_text_beyond_the_sample_is_passed_over(spark):
    from tracemill.llm import toxicity

    docs = spark.createDataFrame([(i, ("vile " if i % 2 else "kind ") * (4000 if i % 7 == 0 else 20), "en") for i in range(200)], "doc_id long, text string, lang string")
    labels = spark.range(200).selectExpr("id doc_id", "int(id % 2) toxic")
    model = toxicity.fit(docs, labels, most_bytes=8000)
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    assert all((s >= 0.5) == bool(i % 2) for i, s in got.items())
    with pytest.raises(ValueError, match="fits"):
        toxicity.fit(docs, labels, most_bytes=8)
