"""Walks and components over edge lists. Each level or round is a written table; nothing is collected but counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .skew import dealt, salted_join
from .store import discarded, materialised


def walk(edges: DataFrame, starts: DataFrame, max_depth: int, fan_out: int, max_nodes: int | None = None) -> DataFrame:
    """root, node, depth, parent and found (which sorts in the order of discovery) of a breadth-first walk from each start (root).

    edges: source, target, ord. A level's edges come in the order of their parent's discovery and then `ord`; a parent follows its first
    `fan_out` edges; a node is found once per root, by the first edge; a root stops, level and all, at `max_nodes` nodes.

    A node's discovery is told by the (ord, node) of the edges that led to it, which sort like a queue within a level, so no root's nodes are
    ranked in one task; only with `max_nodes` are a level's first nodes of each root picked, cut in partitions before they meet.
    Levels are tables of their own and aren't written again."""
    kind = starts.schema["root"].dataType.simpleString()
    order = dict(edges.dtypes)["ord"]
    trail = f"array<struct<ord:{order},node:{kind}>>"
    level = materialised(starts.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("parent"), F.array().cast(trail).alias("found")))
    cut = materialised(edges.withColumn("__n", F.row_number().over(Window.partitionBy("source").orderBy("ord", "target"))).filter(F.col("__n") <= fan_out).drop("__n"))
    levels = [level]
    for depth in range(1, max_depth + 1):
        step = level.alias("f").join(cut.alias("e"), F.col("f.node") == F.col("e.source")).select("f.root", F.col("e.target").cast(kind).alias("node"), F.col("f.node").alias("parent"), F.concat("f.found", F.array(F.struct(F.col("e.ord").alias("ord"), F.col("e.target").cast(kind).alias("node")))).alias("found"))
        seen = table_of(levels)
        fresh = step.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        first = fresh.groupBy("root", "node").agg(F.min(F.struct("found", "parent")).alias("by")).select("root", "node", F.lit(depth).alias("depth"), "by.parent", "by.found")
        if max_nodes is not None:
            held = seen.groupBy("root").agg(F.count("*").alias("held"))
            placed = first.withColumn("__n", F.row_number().over(Window.partitionBy("root").orderBy("found"))).filter(F.col("__n") < max_nodes)
            first = placed.join(held, "root").filter(F.col("__n") + F.col("held") <= max_nodes).drop("__n", "held")
        level = materialised(first)
        if level.isEmpty():
            break
        levels.append(level)
    discarded(cut)
    return table_of(levels).withColumn("found", F.struct("depth", "found"))


def table_of(levels: list[DataFrame]) -> DataFrame:
    """Written tables of one schema as one."""
    return levels[0].sparkSession.read.schema(levels[0].schema).parquet(*[x.scratch_path for x in levels])


def components(edges: DataFrame) -> DataFrame:
    """node and root (smallest node reachable) for edges a, b, by alternating star contraction. Where a hub has over a thousandth of the
    edges, hubs are dealt to several tasks. A round's tables are written once and deleted with it."""
    now = materialised(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    while True:
        n = now.count()
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialised(both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n")).filter("n > 0"))
        large = materialised(hubs_joined(now, least, "a", n, "b").select(F.col("m").alias("a"), "b").distinct())
        low = materialised(large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n")))
        new = materialised(hubs_joined(large, low, "b", n, "a").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a < b").distinct())
        discarded(now, least, large, low)
        # done when every node has one root and no root has one
        size = new.groupBy("b").agg(F.count("*").alias("n")).agg(F.max("n").alias("most")).first()
        if size["most"] in (None, 1) and new.select("a").distinct().join(new.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            return new.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(new.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        now = new


def hubs_joined(rows: DataFrame, side: DataFrame, key: str, n: int, spread: str) -> DataFrame:
    """`rows` joined to `side` (key, m and n: how many of the rows have the key); dealt only if a key has many."""
    if (side.agg(F.max("n").alias("most")).first()["most"] or 0) <= max(256, n // 1000):
        return rows.join(side.drop("n"), key)
    return salted_join(rows, side, [key], "n", n, spread=(spread,))


def stars(places: DataFrame, shared: str, member: str) -> DataFrame:
    """Edges a, b that join all members of what is shared: a star around the first one, not all pairs."""
    hub = places.groupBy(shared).agg(F.min(member).alias("a"), F.count("*").alias("n"))
    return salted_join(places, hub, [shared], "n", places.count(), spread=(member,)).filter(F.col(member) != F.col("a")).select("a", F.col(member).alias("b"))


WALKED = "root long, kind string, node long, parent long, depth int, direction string, rule string, confidence double, place int, queued boolean"


def folded(methods: DataFrame, steps: DataFrame, fold: Callable[[int, list, list], list]) -> DataFrame:
    """Rows that `fold` gives for each root of its methods (in order of place) and its steps (place, node, direction, next, confidence, in order of
    place, direction and n); roots without steps have none. Both pass a task as one sorted stream, which holds a root's rows."""
    none = F.lit(None)
    held = methods.select("root", F.lit(0).alias("kind"), "place", "node", none.cast("string").alias("direction"), none.cast("long").alias("next"), none.cast("double").alias("confidence"), F.lit(0).alias("n"))
    asked = steps.select("root", F.lit(1).alias("kind"), "place", "node", "direction", F.col("next").cast("long").alias("next"), F.col("confidence").cast("double").alias("confidence"), "n")
    rows = dealt(held.unionByName(asked), "root").sortWithinPartitions("root", "kind", "place", "direction", "n").drop("n")
    fields = [f.split() for f in WALKED.split(", ")]
    kinds = {"long": "int64", "int": "int32", "string": "string", "double": "float64", "boolean": "bool"}

    def laid(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, asked = None, [], []
        for batch in batches:
            out = []
            for root, kind, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if root != now:
                    out += fold(now, own, asked) if asked else []
                    now, own, asked = root, [], []
                if kind:
                    asked.append(row)
                else:
                    own.append(row[1])
            yield laid(out)
        if asked:
            yield laid(fold(now, own, asked))

    return rows.mapInArrow(run, WALKED)


def budgeted(edges: DataFrame, implementations: DataFrame, starts: DataFrame, max_depth: int, max_nodes: int, max_callees: int, max_callers: int, max_implementations: int) -> DataFrame:
    """A walk from each start (root) to callees and callers at once: rows of kind method, edge (parent calls node) and prune.

    edges: source, target, ord, confidence; implementations: source, target, ord. A queue of (method, direction) starts with the
    root in both directions; a method is queued once, in the direction that found it first. An entry takes its first neighbours
    up to its direction's limit and the rest of `max_nodes`; entries at `max_depth`, full limits and an empty budget leave prunes,
    and an empty budget ends the walk. Then each method's dispatch targets join at depth 1, within `max_nodes`. A root's rows are at
    most max_nodes times the limits, so one task folds them."""

    def first(df: DataFrame, to: str, by: str, n: int) -> DataFrame:
        return df.select(F.col(by).alias("node"), F.col(to).alias("next"), "ord", "confidence").withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("ord", "next"))).filter(F.col("n") <= n)

    near = materialised(first(edges, "target", "source", max_callees).withColumn("direction", F.lit("callee")).unionByName(first(edges, "source", "target", max_callers).withColumn("direction", F.lit("caller"))))
    limits = {"callee": max_callees, "caller": max_callers}

    def level(depth: int):
        def fold(root: int, held: list, steps: list) -> list:
            out, seen, queued, by = [], dict.fromkeys(held), True, {}
            for place, node, direction, other, confidence in steps:  # in the order of the queue and of the neighbours
                by.setdefault((place, node, direction), []).append((other, confidence))
            for (_, node, direction), near_by in by.items():
                if depth >= max_depth:
                    out.append((root, "prune", node, None, depth, direction, "max_depth", None, None, False))
                    continue
                rest = max_nodes - len(seen)
                if rest <= 0:
                    out.append((root, "prune", node, None, depth, direction, "max_nodes", None, None, False))
                    queued = False
                    break
                limit = min(limits[direction], rest)
                taken = [e for e in near_by if e[0] is not None][:limit]
                for other, confidence in taken:
                    if other not in seen:
                        out.append((root, "method", other, node, depth + 1, direction, None, None, len(seen), True))
                        seen[other] = None
                    parent, child = (node, other) if direction == "callee" else (other, node)
                    out.append((root, "edge", child, parent, None, direction, None, confidence, None, False))
                if limit and len(taken) >= limit:
                    out.append((root, "prune", node, None, depth, direction, f"max_{direction}s_per_node", None, None, False))
            return out if queued else [(*r[:-1], False) for r in out]

        return fold

    def attach(root: int, held: list, steps: list) -> list:
        out, seen = [], dict.fromkeys(held)
        for _, node, _, other, _ in steps:
            if other not in seen and len(seen) >= max_nodes:
                out.append((root, "prune", other, node, 1, "callee", "max_nodes", None, None, False))
                continue
            if other not in seen:
                out.append((root, "method", other, node, 1, "callee", None, None, len(seen), False))
                seen[other] = None
            out.append((root, "edge", other, node, None, "callee", None, 0.8, None, False))
        return out

    empty = F.lit(None)
    found = materialised(starts.select(F.col("root").cast("long").alias("root"), F.lit("method").alias("kind"), F.col("root").cast("long").alias("node"), empty.cast("long").alias("parent"), F.lit(0).alias("depth"), empty.cast("string").alias("direction"), empty.cast("string").alias("rule"), empty.cast("double").alias("confidence"), F.lit(0).alias("place"), F.lit(True).alias("queued")))
    frontier = found.drop("direction").withColumn("direction", F.explode(F.array(F.lit("callee"), F.lit("caller"))))
    levels = [found]
    for depth in range(max_depth + 1):
        steps = frontier.filter("queued").select("root", "place", "node", "direction").join(near.select("node", "direction", "next", "n", "confidence"), ["node", "direction"], "left")
        new = materialised(folded(found.filter("kind = 'method'"), steps, level(depth)))
        levels.append(new)
        found, frontier = table_of(levels), new.filter("kind = 'method'")
        if frontier.filter("queued").isEmpty():
            break
    targets = first(implementations.withColumn("confidence", F.lit(0.8)), "target", "source", max_implementations)
    methods = found.filter("kind = 'method'")
    aimed = methods.select("root", "place", "node").join(targets, "node").withColumn("direction", F.lit("callee"))
    attached = folded(methods, aimed, attach)
    once = Window.partitionBy("root", "parent", "node", "direction").orderBy(F.col("confidence").desc())
    whole = materialised(found.unionByName(attached)).drop("queued")
    edge = whole.filter("kind = 'edge'").withColumn("__n", F.row_number().over(once)).filter("__n = 1").drop("__n")
    return whole.filter("kind != 'edge'").unionByName(edge)


#: What a question to an engine of data flows may have failed at, in order.
UNLANDED = (("sink", "dataflow_sink_unresolved"), ("sink_node", "dataflow_sink_unmatched"), ("source_node", "dataflow_source_unmatched"))


def sliced(questions: DataFrame, flows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Routes, prunes and members of slices, of questions (slice, focus, error, sink, sink_node, source_node: whether each was found) and the
    methods of their flows (slice, method, at).

    An engine's error (dataflow_unavailable) and a question that didn't land leave a named prune, and the slice falls back to the walk. Where
    it landed and no flow is there, the focus stands alone (dataflow_no_path); else the slice is the flow's methods, each once in the order
    of the flow, and its focus."""
    has = flows.select("slice").distinct().withColumn("__flow", F.lit(True))
    told = questions.join(has, "slice", "left")
    rule = F.when(F.col("error").isNotNull(), "dataflow_unavailable")
    for column, name in UNLANDED:
        rule = rule.when(F.col("__flow").isNull() & ~F.coalesce(F.col(column), F.lit(False)), name)
    rule = rule.when(F.col("__flow").isNull(), "dataflow_no_path")
    route = F.when(F.col("rule").isNull(), "flow").when(F.col("rule") == "dataflow_no_path", "focus").otherwise("fallback")
    routed = told.withColumn("rule", rule).withColumn("route", route)
    members = flows.join(routed.filter("route = 'flow'").select("slice"), "slice", "left_semi").groupBy("slice", "method").agg(F.min("at").alias("at"))
    focus = routed.filter("route != 'fallback'").select("slice", F.col("focus").alias("method"), F.lit(-1).alias("at"))
    kept = members.unionByName(focus).groupBy("slice", "method").agg(F.max("at").alias("at"))
    return routed.select("slice", "route"), routed.filter("rule is not null").select("slice", "rule", F.col("focus").alias("method")), kept


def provenance(places: DataFrame, methods: DataFrame, keys: list[str]) -> DataFrame:
    """keys, symbol and via of places (keys, path, line): the innermost method (path, start, end, method) that holds it, via method, else a
    node made up for the file, via file."""
    from . import joins

    held = materialised(places)
    inside = joins.innermost(held, methods, "path", "line", "start", "end", ["method"], F.col("end") - F.col("start"), F.col("method"))
    told = held.join(inside, ["path", "line"], "left")
    return told.select(*keys, F.coalesce("method", F.concat(F.lit("file:"), F.col("path").cast("string"))).alias("symbol"), F.when(F.col("method").isNull(), "file").otherwise("method").alias("via"))
