"""Operators over small tables of the engine's own shapes, with the results that a reader would write down."""

from __future__ import annotations

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from tracemill.operators import dryrun, folds, joins, ledger, material, texts, tools, totals, views


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_dialogue(spark):
    events = spark.createDataFrame(
        [(1, "agent_step", "a", "s", "model call failed: x", None, "{}", None, None, None), (2, "agent_step", "a", "s", "ok", "grep", '{"q":"Needle"}', True, "", None), (3, "agent_step", None, None, None, None, None, False, None, "缺少 x"), (4, "agent_step", "b", "s", "t", None, "{}", True, "", "boom"), (5, "other", "a", "s", "", None, "{}", True, "", "x")],
        "seq int, kind string, agent string, scope string, thought string, tool string, arguments string, ok boolean, summary string, error string",
    )
    told = views.dialogue(events)
    assert rows(told, "seq", "failure_kind") == [(1, "model"), (2, None), (3, "tool_arguments"), (4, "tool_execution")]
    assert rows(views.dialogue_filter(told, needle="needle"), "seq", "total") == [(2, 4)]
    assert rows(views.dialogue_filter(told, problems=True), "seq") == [(3,), (4,)] and rows(views.dialogue_filter(told, agent="b"), "seq") == [(4,)]


def test_coercions(spark):
    df = spark.createDataFrame([(1, '["a", "b"]', "[]", "7"), (2, '"x"', "{}", "0"), (3, "", '{"a":1}', "-1"), (4, None, None, None), (5, '{"k":1}', "x", "two")], "k int, v string, c string, n string")
    assert rows(df, "k", views.as_list(F.col("v"))) == [(1, ["a", "b"]), (2, ["x"]), (3, []), (4, []), (5, ['{"k":1}'])]
    assert rows(df, "k", views.repaired_container(F.col("c"), F.col("k") % 2 == 1)) == [(1, "{}"), (2, "[]"), (3, '{"a":1}'), (4, None), (5, "x")]
    assert rows(df, "k", views.positive_line(F.col("n"))) == [(1, 7), (2, None), (3, None), (4, None), (5, None)]
    usage = spark.createDataFrame([('{"prompt_tokens":5,"prompt_tokens_details":{"cached_tokens":2}}',), ('{"prompt_cache_hit_tokens":3}',)], "u string")
    assert rows(usage, *views.normalised_usage(F.col("u"))) == [(5, None, 2), (None, None, 3)]


def test_blocks(spark):
    b = spark.createDataFrame([("x", 0, "system", None, True, "S"), ("x", 1, "context", "c1", False, "one"), ("x", 2, "context", "c2", False, "two"), ("x", 3, "note", None, False, "end")], "bundle string, at int, kind string, context string, in_prefix boolean, text string")
    assert rows(views.rendered(views.selected_blocks(b, F.lit("c2")), "bundle", "at"), "prompt") == [("two\nend",)]
    assert rows(views.prefix_text(b, "bundle", "at"), "prompt") == [("S",)]
    ranked = b.withColumn("rank", views.block_order({"system": 0, "context": 1}))
    assert rows(ranked, "at", "rank") == [(0, 0), (1, 1), (2, 1), (3, 2)]


def test_containment_bins(spark):
    """Ranges over many bins, points on their ends, and ranges that nest."""
    points = spark.createDataFrame([("f", n) for n in (0, 63, 64, 200, 999)], "path string, line int")
    ranges = spark.createDataFrame([("f", "all", 0, 500, 1), ("f", "mid", 63, 64, 2), ("f", "last", 200, 200, 3), ("g", "other", 0, 999, 4)], "path string, name string, start int, end int, o int")
    assert sorted(rows(joins.contained(points, ranges, "path", "line", "start", "end"), "line", "name")) == [(0, "all"), (63, "all"), (63, "mid"), (64, "all"), (64, "mid"), (200, "all"), (200, "last")]
    assert sorted(rows(joins.innermost(points, ranges, "path", "line", "start", "end", ["name"], F.col("end") - F.col("start")), "line", "name")) == [(0, "all"), (63, "mid"), (64, "mid"), (200, "last")]


def test_verdicts_and_paths(spark):
    c = spark.createDataFrame([(1, "f", None, ["a"]), (2, "f", None, ["b"]), (3, "g", 1, []), (4, "g", 2, ["c"])], "id int, file string, line int, entry_points array<string>")
    v = spark.createDataFrame([(1, "confirmed", ""), (4, "rejected", "no")], "id int, verdict string, reason string")
    assert rows(joins.pending(c, v, ["file", "line"], "id"), "id", "inherited") == [(2, "confirmed"), (3, None)]
    assert rows(joins.rejected(c, v, "id"), "id", "reason") == [(4, "no")]
    paths = spark.createDataFrame([(1, ["x", "a"], True)], "id int, entry_points array<string>, reachable boolean")
    assert rows(joins.paths_fanned(c.filter("id < 3"), paths, ["file"], "id"), "id", "entry_points", "reachable") == [(1, ["x", "a", "b"], True), (2, ["x", "a", "b"], True)]


def test_lead_effects(spark):
    work = spark.createDataFrame([(10, "Is it SAFE?", ["b", "a", "a"])], "work_id int, question string, files array<string>")
    d = spark.createDataFrame([(1, 1, 3, 3, True, "create", " is it safe?", ["a", "b"]), (1, 2, 3, 4, True, "create", "other", ["a"]), (1, 3, 1, 1, True, "create", "is it safe?", ["a"]), (1, 4, 1, 1, False, "dismiss", "x", [])], "batch int, lead int, sequence int, pending_sequence int, pending boolean, action string, question string, files array<string>")
    assert rows(ledger.lead_effects(d, work), "lead", "effect", "work_id") == [(1, "reused", 10), (2, "stale", None), (3, "create", None), (4, "stale", None)]


def test_plans_and_gaps(spark):
    p = spark.createDataFrame([(1, "t", "u", 1, ["f"]), (2, " ", "u", 1, ["f"]), (3, "t", "u", 4, ["f"]), (4, "t", "u", 2, []), (5, "t", None, 2, None)], "k int, a string, b string, priority int, files array<string>")
    assert rows(ledger.plan_rows(p, ["a", "b"], "priority", "files"), "k") == [(1,)]
    before = spark.createDataFrame([(1, 3, 1), (2, 3, 5), (3, 3, 5)], "w int, unread int, attempts int")
    after = spark.createDataFrame([(1, 3, 2), (2, 3, 6), (3, 2, 6), (4, 1, 9)], "w int, unread int, attempts int")
    assert rows(ledger.stalled(before, after, "w", ["unread"], "attempts", 5), "w", "no_progress", "blocked") == [(1, True, False), (2, True, True), (3, False, False), (4, False, False)]
    r = spark.createDataFrame([(1, "gap"), (2, "odd"), (3, "lead")], "id int, kind string")
    assert {n: rows(d, "id") for n, d in ledger.routed(r, {"gaps": ["gap"], "leads": ["lead"]}).items()} == {"gaps": [(1,)], "leads": [(3,)]}
    first = ledger.evidence_ids(r, "id", "kind").filter("id = 1").first()["evidence_id"]
    assert first == hashlib.sha256(b"1\0gap\0").hexdigest()[:20]


def test_axis_and_rounds(spark):
    e = spark.createDataFrame([("plan", 1, "x"), ("odd", 2, "y"), ("plan", 3, "z")], "stage string, at int, state string")
    got = folds.latest_on_axis(e, "stage", "at", ["scan", "plan"], "state").orderBy("place")
    assert [(r["stage"], r["state"]) for r in got.collect()] == [("scan", None), ("plan", "z"), ("odd", "y")]
    s = spark.createDataFrame([(1, "insufficient", 0), (2, "insufficient", 9), (3, "sufficient", 0)], "scope int, state string, failures int")
    assert rows(folds.next_round(s, "state", "failures", 2, F.lit(0.5), 0.1, 1, 3), "scope") == [(1,)]
    assert folds.next_round(s, "state", "failures", 2, F.lit(0.5), 0.1, 4, 3).count() == 0
    c = spark.createDataFrame([("r", 1, {"a": 1}), ("r", 2, {}), ("q", 1, {})], "run string, seq int, counters map<string,int>")
    assert rows(folds.latest_counters(c, "run", "seq", "counters"), "run", "counters") == [("r", {"a": 1})]


def test_census_and_frontend(spark):
    f = spark.createDataFrame([(".py",), (".py",), (".go",), (".go",)], "suffix string")
    c = totals.census(f, "suffix", [".rs"])
    assert rows(c, "suffix", "n", "dominant") == [(".go", 2, True), (".py", 2, False), (".rs", 0, False)]
    assert rows(ledger.frontend(c, "suffix", {".py": "p"}), "suffix", "frontend") == [(".go", None)]
    assert rows(totals.census(f.limit(0), "suffix", [".py"]), "suffix", "dominant") == [(".py", False)]
    calls = spark.createDataFrame([("r", 1, 100, 10), ("r", 2, None, None), ("r", 3, 900_000, 100_000)], "run string, seq int, p int, c int").withColumn("cost", totals.spent(F.col("p"), F.col("c"), 1.0, 10.0))
    assert rows(totals.first_breach(calls, "run", "seq", [("calls", F.lit(1), 5), ("cost", F.col("cost"), 1.0)]), "breach_seq", "cap") == [(3, "cost")]
    v = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("a", 3, "y"), ("a", 0, ""), ("a", 4, None)], "k string, at int, v string")
    assert rows(totals.distinct_in_order(v, "k", "v", "at"), "values") == [(["x", "y"],)]


def test_manifest_parts(spark):
    d = spark.createDataFrame([(1, "lsp_references"), (1, "taint"), (2, "lsp_definition")], "bundle int, capability string")
    m = spark.createDataFrame([(1, "a", "lsp_definition"), (1, "a", "lsp_definition"), (2, "b", "syntax_regex")], "bundle int, method_id string, provider string")
    kept, methods, edges = folds.assembled(d, m, spark.createDataFrame([(1,), (1,)], "bundle int"))
    assert rows(kept, "bundle", "capability") == [(1, "taint"), (2, "lsp_definition")] and methods.count() == 2 and edges.count() == 2


def test_jobs_live_on(spark):
    t = datetime.datetime
    jobs = spark.createDataFrame([(1, "running", 3, t(2024, 1, 1)), (2, "failed", 4, t(2024, 1, 1)), (3, "failed", 4, t(2024, 1, 2))], "job_id int, state string, revision int, beat timestamp")
    beats = spark.createDataFrame([(1, t(2024, 1, 3)), (2, t(2024, 1, 3))], "job_id int, at timestamp")
    got = folds.beaten(jobs, beats)
    assert rows(got, "job_id", "revision", F.dayofmonth("beat")) == [(1, 3, 3), (2, 4, 1), (3, 4, 2)]
    assert rows(folds.expired(got, F.lit("2024-01-02 12:00:00").cast("timestamp"), 86_400), "job_id") == [(1,), (3,)]


def test_workspace_digest(spark):
    files = [("b.py", b"two"), ("a.py", b"one\0"), ("a/x", b"")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
    want = hashlib.sha1(b"".join(p.encode() + b"\0" + c + b"\0" for p, c in sorted(files))).hexdigest()[:16]
    assert rows(texts.workspace_digest(df), "digest") == [(want,)]


def test_dry_run_closes(spark):
    files = spark.createDataFrame([("s", "a", "x\nkey = 1\nkey = 2\neval(x)"), ("s", "b", "eval(y)"), ("t", "c", "nothing"), (None, "d", "key = 3")], "scope string, file string, text string")
    patterns = [("secret", r"key = \d"), ("code", r"eval\(")]
    assert rows(dryrun.signals(files, patterns), "file", "kind", "line") == [("a", "code", 4), ("a", "secret", 2), ("b", "code", 1), ("d", "secret", 1)]
    assert rows(dryrun.run(files, patterns, 2, 3), "scope", "candidates", "rejected", "rounds", "state") == [("s", 2, 2, 2, "sufficient"), ("t", 0, 0, 1, "sufficient"), (None, 1, 1, 2, "sufficient")]
    assert {r["state"] for r in dryrun.run(files, patterns, 2, 1).filter("candidates > 0").collect()} == {"insufficient"}


def test_packets_of_many_candidates_are_no_groups(spark, capsys):
    """Candidates follow each other in a task, each with its own budget, place and blocks seen; no function call a candidate."""
    source = "def f(a):\n    return a\n\n\ndef g():\n    pass\n"
    c = spark.range(300).selectExpr("id candidate_id", "'m.py' file", "1 line", "array('m.py:5', 'm.py:2', 'x.py:1', 'm.py:6') path")
    packets = material.packets(c, spark.createDataFrame([("m.py", source)], "path string, text string"))
    packets.explain()
    assert "FlatMapGroups" not in capsys.readouterr().out
    got = packets.groupBy("candidate_id").agg(F.sort_array(F.collect_list(F.struct("place", "start", "end", "outcome"))).alias("b"))
    assert {tuple(map(tuple, r["b"])) for r in got.collect()} == {((0, 1, 3, "shown"), (1, 5, 6, "shown"), (2, None, None, "unreadable"))}
    assert got.count() == 300


def test_packet_budget(spark):
    source = "def f(a):\n" + "\n".join(f"    x{i} = {i}" for i in range(60)) + "\n\n\ndef g():\n    pass\n"
    c = spark.createDataFrame([(1, "m.py", 30, ["m.py:65", "m.py:40", "n.txt:1", "odd"]), (2, "gone.py", None, None)], "candidate_id int, file string, line int, path array<string>")
    files = spark.createDataFrame([("m.py", source), ("n.txt", "a\nb\nc\nd")], "path string, text string")
    got = material.packets(c, files).orderBy("candidate_id", "place").collect()
    assert [(r["file"], r["start"], r["end"], r["truncated"], r["outcome"]) for r in got] == [("m.py", 1, 61, False, "shown"), ("m.py", 64, 65, False, "shown"), ("n.txt", 1, 3, False, "shown"), ("gone.py", None, None, False, "unreadable")]
    assert got[2]["text"] == "    1 | a\n    2 | b\n    3 | c"
    tight = material.packets(c, files, budget=700).orderBy("candidate_id", "place").collect()
    assert tight[0]["truncated"] and len(tight[0]["text"]) == 500 + len(material.CUT) and tight[1]["outcome"] == "shown" and tight[2]["outcome"] == "shown"
    assert sum(len(r["text"] or "") for r in tight if r["candidate_id"] == 1) <= 700


def test_tools(spark):
    files = spark.createDataFrame([("a/x.py", "one\ntwo\none more"), ("b.py", "three")], "path string, text string")
    calls = spark.createDataFrame([(1, {"pattern": "^one"}), (2, {"pattern": "none at all"}), (3, {}), (4, {"pattern": "o", "odd": "1"}), (5, {"pattern": "o", "limit": "1"})], "call_id int, arguments map<string,string>")
    got = {r["call_id"]: r for r in tools.call("grep", files, calls).collect()}
    assert [got[i]["ok"] for i in range(1, 6)] == [True, True, False, False, True] and got[1]["summary"] == "2 found" and got[2]["data"] == "[]"
    assert got[3]["summary"] == "missing: pattern" and got[4]["summary"] == "unknown: odd" and got[5]["truncated"] and '"line":3' in got[1]["data"]
    listed = tools.call("list_files", files, spark.createDataFrame([(1, {"prefix": "a/"}), (2, {})], "call_id int, arguments map<string,string>"))
    assert {r["call_id"]: r["summary"] for r in listed.collect()} == {1: "1 found", 2: "2 found"}
    read = tools.call("read", files, spark.createDataFrame([(1, {"path": "a/x.py", "offset": "2"}), (2, {"path": "no"})], "call_id int, arguments map<string,string>"))
    assert {r["call_id"]: (r["ok"], r["data"]) for r in read.collect()} == {1: (True, '["two","one more"]'), 2: (False, "[]")}


@pytest.mark.parametrize(("graph", "taint", "want"), [(["py"], ["py"], "full"), (["py"], [], "call_graph"), ([], [], "findings_only"), (None, ["py"], "full")])
def test_language_depth(spark, graph, taint, want):
    assert spark.range(1).select(views.language_depth(F.lit("py"), graph, taint)).first()[0] == want
