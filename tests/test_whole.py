"""Queries without SQL, and some that have it, by brute force on the smallest driver tables."""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from pathlib import Path

import pytest

from tracemill.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")


def rows(spark, table, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{table}.parquet").select(*columns).collect()]


def answer(spark, name):
    return sorted(tuple(r) for r in registry.QUERIES[name](spark, SF).collect())


@pytest.fixture(scope="module")
def edges(spark):
    n = len(rows(spark, "supplier", "s_suppkey"))
    return sorted({(s, p % n) for s, p in rows(spark, "lineitem", "l_suppkey", "l_partkey")})


def test_caller_walk(spark, edges):
    callers = defaultdict(list)
    for s, t in edges:
        callers[t].append(s)
    want = []
    for (root,) in rows(spark, "supplier", "s_suppkey"):
        depth, level = {root: 0}, [root]
        for d in range(1, 4):
            level = [c for n in level for c in sorted(callers[n])[:3] if c not in depth and not depth.update({c: d})]
        want += [(root, n, d) for n, d in depth.items()]
    assert answer(spark, "caller_walk") == sorted(want)


def test_flow_components(spark):
    customer, places = dict(rows(spark, "orders", "o_orderkey", "o_custkey")), defaultdict(set)
    for order, part in rows(spark, "lineitem", "l_orderkey", "l_partkey"):
        if order in customer:
            places[part].add(customer[order])
    parent = {c: c for c in customer.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for group in places.values():
        for c in group:
            a, b = sorted((find(c), find(min(group))))
            parent[b] = a
    shared = {c for g in places.values() if len(g) > 1 for c in g}
    assert answer(spark, "flow_components") == sorted((c, find(c)) for c in shared)


def test_dot_export(spark, edges):
    lines = sorted(tuple(r) for r in registry.QUERIES["dot_export"](spark, SF).filter("part = 1").select("a", "b", "line").collect())
    assert lines == [(s, t, f'  "{s}" -> "{t}" [color="{"gray" if s == t else "black"}"];') for s, t in edges]


def test_prompt_rendering(spark):
    turns = defaultdict(list)
    for c, *turn in sorted(rows(spark, "conversations", "conv_id", "turn", "role", "text")):
        turns[c].append(turn)
    assert answer(spark, "prompt_rendering") == sorted((c, "\n".join(f"{r}: {x}" for _, r, x in t)) for c, t in turns.items())


def test_truncated_json(spark):
    assert answer(spark, "truncated_json") == sorted((e, 1, json.loads(p)["k"], 1, None) for e, p in rows(spark, "events", "event_id", "props"))


def test_idempotent_create(spark):
    first = {}
    for customer, order in rows(spark, "orders", "o_custkey", "o_orderkey"):
        first[customer] = min(order, first.get(customer, order))
    assert answer(spark, "idempotent_create") == sorted(first.items())


def test_bfs_budgeted_starts_everywhere(spark):
    assert {r["root"] for r in registry.QUERIES["bfs_budgeted"](spark, SF).collect()} == {s for (s,) in rows(spark, "supplier", "s_suppkey")}


def test_bounded_read_replay(spark):
    """Files of a scope are read in order while they fit; one that is too big is skipped and later ones may still fit."""
    want, used = [], defaultdict(int)
    for brand, key, size in sorted(rows(spark, "part", "p_brand", "p_partkey", "p_size")):
        if used[brand] + size <= 400:
            used[brand] += size
            want.append((brand, key, size))
    assert answer(spark, "bounded_read_replay") == sorted(want)


def test_claim_batching(spark):
    """First fit: in their order, a claim goes to the first batch of its scope that shares a file with it and stays within four claims and
    eight files, else it opens one; a claim of more files is alone."""
    claims = defaultdict(lambda: defaultdict(set))
    for scope, claim, file in rows(spark, "lineitem", "l_suppkey", "l_orderkey", "l_partkey"):
        claims[scope][claim].add(file)
    want = []
    for scope, own in claims.items():
        batches = []
        for claim in sorted(own):
            for k, (members, files, closed) in enumerate(batches):
                if not closed and len(members) < 4 and files & own[claim] and len(files | own[claim]) <= 8 and len(own[claim]) <= 8:
                    members.append(claim)
                    files |= own[claim]
                    break
            else:
                k = len(batches)
                batches.append(([claim], set(own[claim]), len(own[claim]) > 8))
            want.append((scope, claim, k))
    got = [(r["scope"], r["claim"], r["batch"]) for r in registry.QUERIES["claim_batching"](spark, SF).collect()]
    assert sorted(got) == sorted(want)


WORDS = "if elif else for while switch catch return do try with assert print del in and or not is await yield raise lambda new sizeof typeof defined".split()


def plain_calls(line):
    """Names right before a bracket, but for white space, on a line that declares nothing."""
    head = line.strip()
    if re.match(r"(async\s+)?def\s+[A-Za-z_]\w*\s*\(", head, re.ASCII) or re.match(r"class\s+[A-Za-z_]", head, re.ASCII) or head.endswith("{"):
        return []
    found = []
    for at, ch in enumerate(line):
        if ch != "(":
            continue
        end = at
        while end and line[end - 1].isspace():
            end -= 1
        begin = end
        while begin and (line[begin - 1].isalnum() or line[begin - 1] in "_$"):
            begin -= 1
        while begin < end and line[begin].isdigit() or begin < end and not re.match(r"[A-Za-z_$]", line[begin]):
            begin += 1
        if begin < end and line[begin:end] not in WORDS:
            found.append((begin, line[begin:end]))
    return found


def test_call_sites(spark):
    """Every name before a bracket that isn't a word of the language, wherever it stands, and nothing else."""
    want = []
    for doc, text in rows(spark, "documents", "doc_id", "text"):
        text = re.sub(r"(\w+), (\w+)", r"\1(\2)", text, flags=re.ASCII)
        for n, line in enumerate(text.split("\n"), 1):
            want += [(doc, n, *c) for c in plain_calls(line)]
    got = sorted((r["doc_id"], r["line_no"], r["col"], r["name"]) for r in registry.QUERIES["call_sites"](spark, SF).collect())
    assert got and got == sorted(want)


def test_merged_flows(spark):
    """Orders that share a part of a supplier are one, but for those that don't count."""
    orders = {k: (k % 5 != 0 and s != "P", math.ceil(p) % 5) for k, s, p in rows(spark, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")}
    groups, parent = defaultdict(list), {k: k for k, (anchored, _) in orders.items() if anchored}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = {k: (f"c{c}", k % 97) for k, c in rows(spark, "orders", "o_orderkey", "o_custkey")}
    for place, k in [(own[k], k) for k in parent] + [((f"p{p}", s), k) for k, p, s in rows(spark, "lineitem", "l_orderkey", "l_partkey", "l_suppkey") if k in parent]:
        groups[place].append(k)
    for members in groups.values():
        for k in members:
            a, b = sorted((find(members[0]), find(k)))
            parent[b] = a
    of = defaultdict(list)
    for k in orders:
        of[find(k) if k in parent else -k - 1].append(k)
    level = ["low", "medium", "high", "critical", "odd"]
    want = []
    for members in of.values():
        worst = max(members, key=lambda k: (orders[k][1] if orders[k][1] < 4 else 0, -k))
        want.append((min(members), level[orders[worst][1]], len(members), int(len(members) > 1)))
    assert answer(spark, "merged_flows") == sorted(want)


def test_material_packet(spark):
    shown = defaultdict(list)
    for r in registry.QUERIES["material_packet"](spark, SF).collect():
        shown[r["candidate_id"]].append((r["place"], r["file"], r["start"], r["end"], r["outcome"]))
    for (key,) in rows(spark, "part", "p_partkey"):
        # lines 6 to 10 around the hit join the function of lines 5 to 8; the last step's file isn't there
        assert sorted(shown[key]) == [(0, f"p{key}.py", 5, 10, "shown"), (1, f"p{key}.java", 1, 5, "shown"), (2, f"p{key}.py", 11, 12, "shown"), (3, f"q{key}.py", None, None, "unreadable")]
