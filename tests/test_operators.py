from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracemill.functions import scalars
from tracemill.operators import boards, folds, graph, intervals, packing, rows, tools, totals


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_interval_reach(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 5, 7), ("a", 8, 9), ("a", 20, 21), (None, 1, 1)], "k string, lo int, hi int")
    key = lambda r: tuple(x or "" for x in r)
    assert sorted(map(key, intervals.union(df, ["k"], "lo", "hi", 0).collect())) == [("", 1, 1), ("a", 1, 7), ("a", 8, 9), ("a", 20, 21)]
    assert sorted(map(key, intervals.union(df, ["k"], "lo", "hi", 1).collect())) == [("", 1, 1), ("a", 1, 9), ("a", 20, 21)]
    assert len(intervals.union(df, ["k"], "lo", "hi", 11).collect()) == 2


def test_intervals_of_unknown_ends(spark):
    """Rows without a start or an end come last in their key, where they stand in no other's way."""
    df = spark.createDataFrame([("a", 1, None), ("a", None, None), ("a", 1, 5), ("a", 3, 9), ("a", 20, None), ("b", 2, None), ("b", None, 4)], "k string, lo int, hi int")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, intervals.union(df, ["k"], "lo", "hi", 0).collect())) == [("a", 1, 9), ("a", 20, -1), ("b", -1, 4), ("b", 2, -1)]


def test_gaps(spark):
    merged = spark.createDataFrame([("a", 2, 3), ("a", 6, 10)], "k string, lo int, hi int")
    totals = spark.createDataFrame([("a", 10), ("b", 5)], "k string, total int")
    assert sorted(intervals.gaps(merged, totals, "k", "lo", "hi").collect()) == [("a", 1, 1), ("a", 4, 5), ("b", 1, None)]


def test_walk_budget_and_order(spark):
    edges = spark.createDataFrame([(1, 3, 0), (1, 2, 1), (2, 4, 0), (3, 5, 0), (3, 1, 1), (5, 6, 0)], "source long, target long, ord long")
    start = spark.createDataFrame([(1,)], "root long")
    found = graph.walk(edges, start, max_depth=2, fan_out=5, max_nodes=4)
    assert [r["node"] for r in found.orderBy("found").collect()] == [1, 3, 2, 5]
    assert {r["node"]: r["depth"] for r in graph.walk(edges, start, 9, 1).collect()} == {1: 0, 3: 1, 5: 2, 6: 3}


def brute_budgeted(edges, impls, root, max_depth, max_nodes, callees, callers, most):
    methods, out, queue = {root: 0}, [], [(root, 0, "callee"), (root, 0, "caller")]
    while queue:
        node, depth, way = queue.pop(0)
        if depth >= max_depth:
            out.append(("prune", node, None, "max_depth"))
            continue
        rest = max_nodes - len(methods)
        if rest <= 0:
            out.append(("prune", node, None, "max_nodes"))
            break
        limit = min(callees if way == "callee" else callers, rest)
        taken = sorted(t if way == "callee" else s for s, t in edges if node == (s if way == "callee" else t))[:limit]
        for other in taken:
            if other not in methods:
                methods[other] = depth + 1
                queue.append((other, depth + 1, way))
            out.append(("edge", *((other, node) if way == "callee" else (node, other)), way))
        if len(taken) >= limit:
            out.append(("prune", node, None, f"max_{way}s_per_node"))
    for node in list(methods):
        for other in sorted(t for s, t in impls if s == node)[:most]:
            if other not in methods and len(methods) >= max_nodes:
                out.append(("prune", other, node, "max_nodes"))
                continue
            methods.setdefault(other, 1)
            out.append(("edge", other, node, "callee"))
    edges = {o for o in out if o[0] == "edge"}
    return sorted([*edges, *(o for o in out if o[0] == "prune"), *(("method", n, d, None) for n, d in methods.items())], key=repr)


@pytest.mark.parametrize("budget", [(1, 30, 2, 2, 2), (3, 6, 2, 3, 2), (3, 12, 3, 2, 1), (9, 99, 9, 9, 9)])
def test_budgeted_both_ways(spark, budget):
    edges = sorted({(i * i % 17, (3 * i + 1) % 19) for i in range(40)})
    impls = [(i, 20 + i % 5) for i in range(19)] + [(i, 30 + i) for i in range(9)]
    df = spark.createDataFrame(edges, "source long, target long").selectExpr("*", "target as ord", "1.0D as confidence")
    # callers come in the order of their own number
    df = df.selectExpr("source", "target", "0L as ord", "confidence")
    found = graph.budgeted(df, spark.createDataFrame(impls, "source long, target long").selectExpr("*", "target as ord"), spark.createDataFrame([(1,), (4,), (99,)], "root long"), *budget).collect()
    for root in (1, 4, 99):
        got = [(r["kind"], r["node"], r["depth"], None) if r["kind"] == "method" else (r["kind"], r["node"], r["parent"], r["rule"] or r["direction"]) for r in found if r["root"] == root]
        assert sorted(got, key=repr) == brute_budgeted(edges, impls, root, *budget)


def test_components_chain_and_empty(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101), (5, 5)], "a long, b long")
    assert pairs(graph.components(chain), "node", "root") == sorted([(i, 0) for i in range(21)] + [(100, 100), (101, 100)])
    assert graph.components(chain.limit(0)).count() == 0


def test_greedy_fit_skips_what_is_too_big(spark):
    df = spark.createDataFrame([("s", 1, 6), ("s", 2, 9), ("s", 3, 4), ("s", 4, 1)], "k string, o long, n int")
    assert pairs(rows.greedy_fit(df, "k", "o", "n", 10), "o") == [(1,), (3,)]


def test_first_fit_shares_files(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (1, 3, 10), (1, 3, 11), (1, 4, 10)], "scope long, claim long, file long")
    assert pairs(packing.first_fit(df, 2, 3), "claim", "batch") == [(1, 0), (2, 1), (3, 0), (4, 2)]


def test_ordinal_is_dense(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id"))
    got = rows.ordinal(df, "at", F.col("k")).orderBy("k").select("at").collect()
    assert [r[0] for r in got] == list(range(1000))


def test_override_and_insert(spark):
    l, r = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, v string"), spark.createDataFrame([("b", "z"), ("c", None)], "k string, v string")
    assert sorted((x["k"], x["v"] or "") for x in rows.override(l, r, "k", ["v"]).collect()) == [("a", "x"), ("b", "z"), ("c", "")]
    assert pairs(rows.insert_absent(l, spark.createDataFrame([(" c ", "1"), ("a", "2"), ("", "3"), ("c", "0")], "k string, v string"), "k", F.col("v")), "k", "v") == [("a", "x"), ("b", "y"), ("c", "0")]


@pytest.mark.parametrize(("text", "want"), [("SQL Injection", "sql_injection"), ("NoSQL thing", "nosql_injection"), (None, "other"), ("  ", "other"), ("Odd class!", "odd_class"), ("idor", "idor")])
def test_vulnerability_type(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(scalars.vulnerability_type(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(
    ("text", "tokens"), [("", 0), ("abcd", 2), ("漢字かな", 4), ("a" * 11, 3)],
)
def test_token_estimate(spark, text, tokens):
    assert spark.createDataFrame([(text,)], "t string").select(scalars.estimate_tokens(F.col("t"))).first()[0] == tokens


def test_confidences(spark):
    df = spark.createDataFrame([(85.0, None), (None, "85%"), (None, "0.6 (medium)"), (None, "none"), (-1.0, None), (None, None)], "n double, t string")
    got = df.select(scalars.verdict_confidence(F.col("n"), F.col("t")).alias("v"), scalars.harness_confidence(F.col("n"), F.col("t")).alias("h")).collect()
    assert [r["v"] for r in got] == [1.0, 0.85, 0.6, None, 0.0, None]
    assert [r["h"] for r in got] == [0.85, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_role_and_leading(spark):
    df = spark.createDataFrame([("src/main/java/shop/controllers/X.java",), ("a/task_run.py",), ("OrderRequestDTO.java",)], "p string")
    got = [tuple(r[0]) for r in df.select(scalars.role_of_path(F.col("p"))).collect()]
    assert got == [("web-route", "shop/controllers"), ("batch-task", "a"), (None, "")]
    levels = spark.createDataFrame([("High: yes",), ("highest",), ("low",)], "t string").select(scalars.leading_severity(F.col("t")).alias("s")).collect()
    assert [r["s"]["level"] for r in levels] == ["high", None, "low"]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_a_join(spark, how, monkeypatch):
    """Keys with most of the rows, rare ones, and ones that the side lacks."""
    from tracemill.operators import skew

    left = spark.range(2000).selectExpr("id", "if(id % 3 = 0, -1, id % 500) as k")
    side = left.filter("k % 7 != 3").groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    got = skew.salted_join(left, side, ["k"], "n", 2000, how, spread=("id",))
    assert pairs(got, "id", "k", "v") == pairs(left.join(side.drop("n"), "k", how), "id", "k", "v")
    parts = got.withColumn("p", F.spark_partition_id()).filter("k = -1").select("p").distinct().count()
    assert parts > 1


def test_what_concerns_work_is_counted_without_pairs(spark):
    """Counts are those of the pairs: rows told twice, by several, without a teller or a file, and items with several or no files."""
    told = [(1, "w1", "a"), (2, "w2", "a"), (3, "w3", "b"), (3, "w1", "c"), (4, "w1", "b"), (4, "w1", "b"), (5, None, "a"), (6, "w2", None), (7, "w1", "a"), (7, "w2", "a"), (8, "w9", "c")]
    seen = [("w1", "a"), ("w1", "b"), ("w2", "b"), ("w2", "b"), ("w3", "c"), ("w4", "a"), ("w9", "a")]
    work = ["w1", "w2", "w3", "w4", "w5"]
    expected = []
    for w in work:
        mine = [(r, by) for r, by, f in told if by == w or (w, f) in seen]
        if mine:
            expected.append((w, len({r for r, _ in mine}), len({r for r, by in mine if by not in (None, w)})))
    got = boards.concerned(spark.createDataFrame(told, "row long, work_id string, file string"), spark.createDataFrame([(w,) for w in work], "work_id string"), spark.createDataFrame(seen, "work_id string, file string"))
    assert pairs(got, "work_id", "n", "near") == expected


def test_a_file_of_many_items_makes_no_pairs(spark):
    """2,000 items on one file of 20,000 rows: 40 million pairs, as sums."""
    told = spark.range(20_000).select(F.col("id").alias("row"), (F.col("id") % 2_000).alias("work_id"), F.lit("f").alias("file"))
    work = spark.range(2_000).select(F.col("id").alias("work_id"))
    got = boards.concerned(told, work, work.withColumn("file", F.lit("f"))).cache()
    assert [tuple(r) for r in got.select("n", "near").distinct().collect()] == [(20_000, 19_990)]
    assert got.count() == 2_000


def test_rows_of_one_arrival(spark):
    """Ties have one answer in any order of rows: the last by arrival is the first by seq, and what a run did before its start isn't since it."""
    log = [(1, 5, 10, "step"), (1, 5, 11, "start"), (1, 5, 12, "step"), (1, 5, 13, "end"), (2, 7, 3, "end"), (2, 7, 1, "start"), (2, None, 0, "step")]
    kind = F.col("kind")
    for order in (log, log[::-1]):
        df = spark.createDataFrame(order, "run long, arrival long, seq long, kind string").coalesce(1)
        assert pairs(folds.latest_by(df, "run", "arrival", "kind", seq="seq"), "run", "kind", "arrival") == [(1, "step", 5), (2, "start", 7)]
        assert pairs(folds.agent_rows(df, "run", "arrival", kind == "start", kind == "step", kind == "end", "seq"), "run", "starts", "steps", "ended") == [(1, 1, 1, 5), (2, 1, 0, 7)]


def test_first_of_one_arrival_by_seq(spark, tmp_path):
    """Twelve views of one arrival, written backwards."""
    from tracemill.plans import registry

    log = [(10007 * n, None, 1, "view", 0.0, '{"k": 1}') for n in range(12, 0, -1)]
    spark.createDataFrame(log, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert pairs(registry.QUERIES["topk_new_per_scope"](spark, str(tmp_path)), "seq") == [(10007 * n,) for n in range(1, 6)]


def test_all_tasks_search_the_few_bytes_of_one_split(spark):
    files = spark.createDataFrame([(f"d/p{i}.py", f"a\nb{i}\na") for i in range(20)], "path string, text string").coalesce(1)
    calls = spark.createDataFrame([(1, {"pattern": "^b1"}), (2, {"pattern": "^a$", "include": "p3.*"}), (3, {"pattern": "c"}), (4, {"pattern": "b7", "path": "d/p7.py"})], "call_id long, arguments map<string,string>")
    assert tools.met(files, calls).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert pairs(tools.call("grep", files, calls), "call_id", "summary") == [(1, "11 found"), (2, "2 found"), (3, "0 found"), (4, "1 found")]


def test_run_counters_hold_no_split(spark, capsys):
    """Rows of a split are dealt before they are made distinct: the first aggregate stands above the exchange."""
    df = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (1, 1, 2), (1, 2, 1), (2, 1, 1)], "run long, slice long, method long").coalesce(1)
    got = totals.run_counters(df, "run", "method", "slice")
    got.explain()
    plan = capsys.readouterr().out
    assert plan.rindex("HashAggregate") < plan.index("REPARTITION_BY_NUM")
    assert pairs(got, "run", "slices", "methods", "methods_in_slices") == [(1, 2, 2, 3), (2, 1, 1, 1)]
