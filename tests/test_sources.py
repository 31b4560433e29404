from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tracemill.sources import code, records, sarif, sinks

REPO = {
    "shelf.py": "from stock import count\n\n\n@timed\ndef refill(order):\n    return pick(order)\n\n\ndef pick(order):\n    def label(x):\n        return x\n    return count(order)\n",
    "stock.py": "class Stock:\n    def count(self, q):\n        return table.rows(q)\n",
}


def result(uri="app.py", line=6, rule="r1", level="error"):
    return {"ruleId": rule, "level": level, "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": uri}, "region": {"startLine": line, "startColumn": 12, "endLine": line, "endColumn": 60, "snippet": {"text": "a\n  b"}}}}]}


def write(path, doc):
    path.write_text(doc if isinstance(doc, str) else json.dumps(doc))


def test_sarif(spark, tmp_path):
    rules = [{"id": "r1", "properties": {"tags": ["x", "high"]}}, {"id": "r2", "aliases": ["old"], "defaultConfiguration": {"level": "note"}}, {}]
    rows = [result(), result("file:///w/b.py", 1, "r2", ""), result(rule="old", level=None), {"ruleId": "r1", "message": {"text": "no place"}}, result(level="", line=0)]
    write(tmp_path / "a.sarif", {"runs": [{"tool": {"driver": {"name": "t", "rules": rules}}, "results": rows}]})
    got = sorted(sarif.findings(spark, str(tmp_path)).collect(), key=lambda r: (r["rule"], r["start_line"]))
    assert [(r["rule"], r["severity"], r["path"], r["start_line"], r["start_char"]) for r in got] == [("old", "note", "app.py", 5, 11), ("r1", "error", "app.py", 0, 11), ("r1", "error", "app.py", 5, 11), ("r2", "note", "/w/b.py", 0, 11)]
    assert got[0]["snippet"] == "a b" and got[0]["finding_id"].startswith("F-") and len(got[0]["finding_id"]) == 14


def test_invalid_sarif_is_an_error(spark, tmp_path):
    write(tmp_path / "a.sarif", "{not json")
    with pytest.raises(Exception, match="invalid SARIF json"):
        sarif.findings(spark, str(tmp_path)).collect()


def test_jsonl_damage_and_pages(spark, tmp_path):
    write(tmp_path / "t.jsonl", "\n".join([*(json.dumps({"seq": i, "kind": "k"}) for i in range(5)), '{"seq": 9, "ki', "[1]", ""]))
    rows = records.jsonl(spark, str(tmp_path), "seq long, kind string")
    page = records.tail(rows, "seq", 2).collect()
    assert [(r["seq"], r["total"], r["n_damaged"]) for r in page] == [(4, 5, 2), (3, 5, 2)]
    assert [r["seq"] for r in records.after(rows, 2).collect()] == [3, 4]


def test_files_and_methods(spark, tmp_path):
    for name, text in REPO.items():
        write(tmp_path / name, text)
    (tmp_path / ".git").mkdir()
    write(tmp_path / ".git" / "x.py", "def no(): pass")
    (tmp_path / "bin.py").write_bytes(b"a\0b")
    texts = records.texts(records.workspace_files(spark, str(tmp_path), (".py",)))
    assert sorted((r["path"], r["state"]) for r in texts.collect()) == [("bin.py", "binary"), ("shelf.py", "ok"), ("stock.py", "ok")]
    found = code.methods(texts.filter("state = 'ok'"), "path", "text").collect()
    assert sorted((r["path"], r["name"], r["start"], r["end"], r["owner"]) for r in found) == [("shelf.py", "pick", 8, 11, None), ("shelf.py", "refill", 3, 5, None), ("stock.py", "count", 1, 2, "Stock")]
    edges = code.innermost_calls(texts.filter("state = 'ok'").select("path", "text")).collect()
    assert sorted((r["caller"], r["callee"]) for r in edges) == [("count", "rows"), ("pick", "count"), ("refill", "pick")]


def test_braced_methods():
    text = "class A {\n  public int f(int x) {\n    if (x > 0) {\n      s = \"}\";\n    }\n    return g(x);\n  }\n}\n"
    assert code.braced_methods(text) == [("f", 1, 6, None)]


def test_skip_sets(spark, tmp_path):
    """The three scans leave out folders of their own; only the survey passes hidden ones over, and a file's own name is never asked."""
    for name in ("a.py", "build/b.py", "venv/c.py", ".hidden/d.py", "target/e.py", ".mypy_cache/f.py", "x/dist", "bin/g.py", "up/H.PY", "vendor/i.txt", "__init__.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        write(tmp_path / name, "x")
    paths = lambda df: [r["path"] for r in df.select("path").collect()]
    assert paths(records.workspace_files(spark, str(tmp_path), (".py",))) == [".hidden/d.py", "__init__.py", "a.py", "bin/g.py", "build/b.py", "target/e.py", "up/H.PY"]
    assert paths(records.inventory_files(spark, str(tmp_path))) == [".hidden/d.py", "__init__.py", "a.py", "bin/g.py", "target/e.py", "up/H.PY"]
    assert paths(records.survey_files(spark, str(tmp_path))) == ["__init__.py", "a.py", "up/H.PY", "x/dist"]


@pytest.mark.parametrize("word", ["if", "else", "sizeof", "raise", "yield", "new", "typeof", "lambda", "await"])
def test_words_that_are_no_calls(word):
    assert code.calls_in(f"x = 1; {word} (y)") == []


def test_calls_with_signs_and_spaces():
    assert code.calls_in("a . b$c (x); $q(1); class F(Base):") == [(1, 4, "a", "b$c"), (1, 13, None, "$q"), (1, 26, None, "F")]
    assert code.calls_in("class F(Base):") == [] and code.calls_in("  public int f(int x) {") == []


def test_two_reports_keep_their_flows(spark, tmp_path):
    for name, codes in (("a", ("x1", "x2")), ("b", ("y1",))):
        write(tmp_path / f"{name}.tsv", "".join(f"ELEM\t0\tCALL\tf\ta.py\t1\t{c}\n" for c in codes))
    assert sorted([e["code"] for e in r["elements"]] for r in records.flow_report(spark, str(tmp_path)).collect()) == [["x1", "x2"], ["y1"]]


def test_last_session(spark):
    """A session that comes back after another begins anew."""
    rows = spark.createDataFrame([("r", 1, "A"), ("r", 2, "B"), ("r", 3, "A"), ("q", 1, None), ("q", 2, None), (None, 1, "A")], "run string, seq int, session string")
    assert sorted((r["run"] or "", r["seq"]) for r in records.last_session(rows, "run", "session", "seq").collect()) == [("", 1), ("q", 1), ("q", 2), ("r", 3)]


def test_flow_report(spark, tmp_path):
    write(tmp_path / "r.tsv", "ANCHOR\tx\nELEM\t0\tCALL\tf\ta.py\t3\tf(x)\nELEM\tbad\nELEM\t1\tID\tg\tb.py\t?\ty\nELEM\t0\tRET\tf\ta.py\t4\tz\nFLOW_COUNT\t2\n")
    got = {r["flow"]: [e["code"] for e in r["elements"]] for r in records.flow_report(spark, str(tmp_path)).collect()}
    assert got == {0: ["f(x)", "z"], 1: ["y"]}


def test_symbols(spark):
    r = {"start": {"line": 1, "character": 0}, "end": {"line": 9, "character": 0}}
    payload = json.dumps([{"name": "A", "kind": 5, "range": r, "children": [{"name": "f", "kind": 6, "range": r}]}, {"name": "g", "kind": 12, "location": {"uri": "x", "range": r}, "containerName": "M"}])
    got = records.symbols(spark, spark.createDataFrame([("p", payload)], "path string, payload string"), depth=2).collect()
    assert sorted((s["name"], s["parent"], s["range"]["start"]["line"]) for s in got) == [("A", "", 1), ("f", "A", 1), ("g", "M", 1)]


def test_manifests_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.json", {"bundle_id": "a", "created_at": "2024"})
    write(tmp_path / "in" / "b.json", "{broken")
    rows = records.newest_first(records.documents(spark, str(tmp_path / "in"), "bundle_id string, created_at string")).collect()
    assert [(r["bundle_id"], r["error"]) for r in rows] == [("a", None), (None, "unreadable")]
    for name, doc in (("b1", {"created_at": "2024-02", "prunes": [{}, {}], "methods": [{"provider": "z"}, {"provider": "a"}, {"provider": "z"}, {}]}), ("b2", {"created_at": None}), (".half", {"created_at": "2025"}), ("b3", "{broken")):
        (tmp_path / "out" / name).mkdir(parents=True)
        write(tmp_path / "out" / name / "manifest.json", doc)
    rows = records.manifests(spark, str(tmp_path / "out" / "*"), "created_at string, prunes array<struct<rule:string>>, methods array<struct<provider:string>>").collect()
    assert [(r["bundle_id"], r["error"], r["prune_count"], r["providers"]) for r in rows][:1] == [("b1", None, 2, ["a", "z"])]
    assert {(r["bundle_id"], r["error"], r["prune_count"]) for r in rows} == {("b1", None, 2), ("b2", None, 0), ("b3", "unreadable", None)}
    df = spark.createDataFrame([(2, [1] * 60, "zz"), (1, [2], "start")], "k int, xs array<int>, kind string")
    sinks.ordered_jsonl(df, str(tmp_path / "out"), df.k)
    assert [json.loads(x)["k"] for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()] == [1, 2]
    assert sorted((r["k"], len(r["xs"]), r["xs_omitted"]) for r in sinks.slim(df, ["xs"]).collect()) == [(1, 1, 0), (2, 50, 10)]
    assert sorted((r["kind"], r["raw_kind"]) for r in sinks.known_kinds(df, ["start"]).collect()) == [("start", None), ("unknown", "zz")]
    assert "| k |" in sinks.markdown(df.select("k"), "T")
    assert {r["line"] for r in sinks.table_lines(df.select("k", "kind")).collect()} == {"| 2 | zz |", "| 1 | start |"}


def test_appending_sinks(spark, tmp_path):
    """Traffic rotates to one older generation, trails number on, archives have a folder a run, reports hold what was judged."""
    rows = spark.createDataFrame([(1, "x" * 500, "start"), (2, "y", "odd")], "k int, text string, kind string")
    for _ in range(3):
        sinks.traffic(rows, str(tmp_path / "t"), ["text"], most_bytes=500)
    now, before = (spark.read.json(str(tmp_path / "t" / n)) for n in ("now", "before"))
    assert now.count() == 2 and before.count() == 4 and max(len(r["text"]) for r in now.collect()) == 300
    sinks.trail(rows, str(tmp_path / "trail"), ["start"], 7, F.col("k"))
    assert sorted((r["seq"], r["kind"], r["raw_kind"]) for r in spark.read.json(str(tmp_path / "trail")).collect()) == [(8, "start", None), (9, "unknown", "odd")]
    sinks.step_archive(spark.createDataFrame([("a/b", 1), ("a:b", 2)], "run_id string, step int"), str(tmp_path / "steps"))
    assert len(list((tmp_path / "steps").glob("run_folder=a_b-*"))) == 2
    sinks.verdicts(spark.createDataFrame([(1, "confirmed", "text"), (2, None, "raw")], "call_id int, verdict string, answer string"), str(tmp_path / "ai"))
    assert spark.read.json(str(tmp_path / "ai" / "verdicts")).count() == 1 and spark.read.json(str(tmp_path / "ai" / "answers")).count() == 2
    nodes, edges = spark.createDataFrame([(2, "b"), (1, "a")], "id int, label string"), spark.createDataFrame([(1, 2, "syntax_regex")], "source int, target int, provider string")
    sinks.dot_file(nodes, edges, str(tmp_path / "dot"))
    text = "\n".join(p.read_text().strip("\n") for p in sorted((tmp_path / "dot").glob("part-*")) if p.stat().st_size)
    assert text.split("\n") == ["digraph calls {", '  "1" [label="a"];', '  "2" [label="b"];', '  "1" -> "2" [color="orange"];', "}"]
