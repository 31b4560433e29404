"""What steps move and hold: rows computed once, keys dealt by number, one struct a claim."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tracemill.operators import contexts, folds, graph, inbox, joins, packing, skew, tools
from tracemill.sources import code


def plan_of(df, capsys):
    df.explain()
    return capsys.readouterr().out


def counted(spark, df):
    """`df` and an accumulator of how many of its rows were computed."""
    n = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), n


def test_members_of_contexts_are_computed_once(spark):
    """Members and methods without a prune don't come to the join that counts its rows first."""
    of = spark.createDataFrame([("b", "C1", "m1")], "bundle string, context_id string, focus string")
    members, n = counted(spark, spark.createDataFrame([("b", "C1", f"m{i}") for i in range(1, 9)] * 2, "bundle string, context_id string, method_id string"))
    prunes = spark.createDataFrame([("b", "m1", "one"), ("b", "m2", "two"), ("b", None, "all")], "bundle string, method_id string, rule string")
    got = sorted(r["rule"] for r in contexts.prune_views(of, members, prunes, 0).collect())
    assert got == ["all", "one", "two"] and n.value == 16


def test_named_findings_are_computed_once(spark):
    slices = spark.createDataFrame([("b", 1, "m1", "p", 1, "x"), ("b", 2, "m2", "p", 1, "x")], "bundle string, slice int, focus string, path string, line int, provider string")
    refs = spark.createDataFrame([("b", 1, "m1", 0), ("b", 2, "m2", 0)], "bundle string, slice int, method_id string, depth int")
    named, n = counted(spark, spark.createDataFrame([("b", 1, "F1"), ("b", 2, "F2"), ("b", 2, "F9")], "bundle string, slice int, finding_id string"))
    findings, m = counted(spark, spark.createDataFrame([("b", "F1", "error"), ("b", "F2", "note")], "bundle string, finding_id string, severity string"))
    bodies = spark.createDataFrame([("b", "m1", "h")], "bundle string, method_id string, content_hash string")
    got = {r["focus"]: (r["discoverable"], r["known"], r["place"]) for r in contexts.contexts(slices, refs, named, findings, bodies, 8).collect()}
    assert got == {"m1": (1, 1, 1), "m2": (2, 1, 2)} and n.value == 3 and m.value == 2


def test_keys_are_counted_in_groups(spark, monkeypatch):
    """Groups that are large tell nothing; then keys are counted, and a frequent one is still dealt."""
    left = spark.createDataFrame([(i, 0 if i % 2 else i) for i in range(2000)], "id int, k int")
    side = left.select("k").distinct().withColumn("v", F.col("k") + 1)
    for groups in (1, 1 << 16):
        monkeypatch.setattr(skew, "GROUPS", groups)
        assert skew.keyed_join(left, side, ["k"], "inner", ("id",)).filter("v = k + 1").count() == 2000


def test_points_are_dealt_before_they_are_distinct(spark, capsys):
    points = spark.createDataFrame([(1, 5, "p"), (1, 5, "p"), (2, 9, "p")], "id int, line int, path string").coalesce(1)
    ranges = spark.createDataFrame([("p", 1, 9, "a", 1), ("p", 4, 6, "b", 2)], "path string, start int, `end` int, method string, k int")
    got = joins.widest_start(points, ranges, "path", "line", "start", "end", "method", "k", ["id", "line"])
    assert sorted(map(tuple, got.collect())) == [(1, 5, "b"), (2, 9, "a")]
    assert "REPARTITION_BY_NUM" in plan_of(got, capsys)


def test_jobs_are_dealt_by_number(spark, capsys):
    events = spark.createDataFrame([(1, 1, 1, "submitted", "a"), (1, 2, 2, "claimed", "a")], "job long, at long, seq long, kind string, consumer string").coalesce(1)
    got = inbox.held(events, "job", ["a"], 10, 10, until=5)
    assert sorted(r["state"] for r in got.collect()) == ["queued", "running"]
    assert "REPARTITION_BY_NUM" in plan_of(got, capsys)


def test_files_are_dealt_before_they_are_read(spark, capsys):
    """One partition of files doesn't stay one task."""
    files = spark.createDataFrame([(f"{i}.py", f"def f{i}(a):\n    return g(a)\n") for i in range(9)], "path string, text string").coalesce(1)
    got = code.innermost_calls(files)
    assert sorted(r["caller"] for r in got.collect()) == [f"f{i}" for i in range(9)]
    assert plan_of(got, capsys).count("REPARTITION_BY_NUM") >= 3


def test_reads_meet_files_by_number(spark, capsys, monkeypatch):
    monkeypatch.setattr(tools, "MOST_BROADCAST", 1)
    files = spark.createDataFrame([("a.py", "x\ny"), ("b.py", "z")], "path string, text string")
    calls = spark.createDataFrame([(1, {"path": "a.py"}), (2, {"path": "b.py"}), (3, {"path": "c.py"})], "call_id int, arguments map<string,string>")
    got = tools.call("read", files, calls)
    assert sorted((r["call_id"], r["ok"], r["data"]) for r in got.collect()) == [(1, True, '["x","y"]'), (2, True, '["z"]'), (3, False, "[]")]
    assert plan_of(got, capsys).count("REPARTITION_BY_NUM") >= 2


def test_one_struct_a_claim_moves(spark, capsys):
    """The representative is read from the greatest struct, not summed up beside it; nulls in a claim are equal."""
    members = spark.createDataFrame([("a", 1, 3), ("b", 1, 9), ("c", None, 4), ("d", None, 2)], "id string, claim int, weight int")
    got = folds.fanned_out(members, ["claim"], "id", F.struct("weight", "id"), F.when(F.col("__w.weight") > 5, "yes").otherwise("no"))
    assert sorted(map(tuple, got.collect())) == [("a", "b", "yes", True), ("b", "b", "yes", False), ("c", "c", "no", False), ("d", "c", "no", True)]
    assert "max_by" not in plan_of(got, capsys)


def test_claims_meet_only_batches_of_their_files(spark):
    """First fit as by looking through all batches, with a hundred times fewer comparisons."""
    rng = random.Random(3)
    claims = [sorted({rng.randrange(60) for _ in range(rng.randrange(1, 7))}) for _ in range(400)]
    held, want = [], []
    for own in map(set, claims):
        at = next((i for i, (h, n) in enumerate(held) if len(own) <= 5 and n < 4 and h & own and len(h | own) <= 5), None)
        if at is None:
            held.append((own, 4 if len(own) > 5 else 1))
            at = len(held) - 1
        else:
            held[at] = (held[at][0] | own, held[at][1] + 1)
        want.append(at)
    packed = packing.Batches(4, 5)
    assert [packed.add(files) for files in claims] == want
    df = spark.createDataFrame([(s, c, f) for s in (1, 2) for c, files in enumerate(claims) for f in files], "scope int, claim int, file int")
    got = {(r["scope"], r["claim"]): r["batch"] for r in packing.first_fit(df, 4, 5).collect()}
    assert got == {(s, c): at for s in (1, 2) for c, at in enumerate(want)}


def test_roots_are_folded_as_a_stream(spark, capsys):
    edges = spark.createDataFrame([(1, 2, 0, 1.0), (2, 3, 0, 1.0), (4, 1, 0, 0.5)], "source long, target long, ord long, confidence double")
    none = spark.createDataFrame([], "source long, target long, ord long")
    starts = spark.createDataFrame([(i,) for i in range(1, 40)], "root long")
    got = graph.budgeted(edges, none, starts, 2, 9, 4, 4, 4).filter("root = 1")
    assert sorted(r["node"] for r in got.filter("kind = 'method'").collect()) == [1, 2, 3, 4]
    held = graph.folded(starts.selectExpr("root", "0 place", "root node"), starts.selectExpr("root", "0 place", "root node", "'callee' direction", "root next", "1.0D confidence", "1 n"), lambda root, own, asked: [(root, "method", own[0], None, len(asked), None, None, None, 0, True)])
    assert sorted((r["root"], r["node"], r["depth"]) for r in held.collect()) == [(i, i, 1) for i in range(1, 40)]
    assert "CoGroup" not in plan_of(held, capsys)
