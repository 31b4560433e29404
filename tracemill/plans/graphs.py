"""Queries over call edges: walks, reachability and components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import graph, joins, rows
from ..sources import sinks
from .adapters import Tables
from .registry import query


@query("GX-1 GX-3")
def bfs_budgeted(t: Tables) -> DataFrame:
    """Callees, callers, prunes and dispatch targets; the second lines of orders stand for implementations."""
    provider = F.when(F.col("source") == F.col("target"), "file_range").otherwise("lsp_call_hierarchy")
    second = t.lineitem.filter("l_linenumber = 2").select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % t.n_paths).alias("target")).distinct().withColumn("ord", F.col("target"))
    starts = t.supplier.select(F.col("s_suppkey").alias("root"))
    return graph.budgeted(t.edges().withColumn("confidence", scalars.confidence(provider)), second, starts, max_depth=3, max_nodes=30, max_callees=4, max_callers=4, max_implementations=4)


@query("GX-2", """with recursive w(root, node, depth) as (select s_suppkey, s_suppkey, 0 from supplier union select w.root, e.source, w.depth + 1 from w join (
    select *, row_number() over (partition by target order by source) n from v_edges) e on e.target = w.node where e.n <= 3 and w.depth < 3)
    select root, node, min(depth) depth from w group by 1, 2""")
def caller_walk(t: Tables) -> DataFrame:
    back = t.edges().select(F.col("target").alias("source"), F.col("source").alias("target"), F.col("source").alias("ord"))
    return graph.walk(back, t.supplier.select(F.col("s_suppkey").alias("root")), max_depth=3, fan_out=3).select("root", "node", "depth")


@query("GX-8")
def flow_components(t: Tables) -> DataFrame:
    """Customers that share a part, as components; places meet in a star around each part's first customer."""
    places = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey").distinct()
    return graph.components(graph.stars(places, "l_partkey", "o_custkey")).select("node", "root")


@query("GX-4 AG-29", "select l_orderkey, min(l_linenumber) filter (where l_returnflag = 'R') first_focus, max(l_linenumber) filter (where l_returnflag = 'R') last_focus, max(l_linenumber) - coalesce(max(l_linenumber) filter (where l_returnflag = 'R'), 999) depth from lineitem group by 1")
def flow_depth(t: Tables) -> DataFrame:
    return joins.flow_depth(t.lineitem, "l_orderkey", "l_linenumber", F.col("l_returnflag") == "R")


@query("GX-5", "with h as (select source, target from v_edges where source % 3 <> 0), x as (select distinct l_suppkey source, l_partkey % (select count(*) from supplier) target from lineitem) select source, target, 'hierarchy' via from h union all select source, target, 'lexical' from x where source <> target and source not in (select source from h)")
def callee_resolution(t: Tables) -> DataFrame:
    """A hierarchy that doesn't know every third supplier, and lexical calls of all lines."""
    lexical = t.lineitem.select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % t.n_paths).alias("target"))
    return joins.callees(t.edges().filter("source % 3 != 0"), lexical)


@query("GX-7 GR-1", "select source, target, count(*) over (partition by source) out_degree, case when source = target then 0.2::double else 1.0 end confidence from v_edges")
def edge_confidence(t: Tables) -> DataFrame:
    provider = F.when(F.col("source") == F.col("target"), "file_range").otherwise("lsp_call_hierarchy")
    return joins.out_degrees(t.edges()).select("source", "target", "out_degree", scalars.confidence(provider).alias("confidence"))


@query("GX-9", """with recursive e as (select distinct l_suppkey source, (l_suppkey + l_partkey % 3) % (select count(*) from supplier) target from lineitem), r(root, node, depth) as (
    select s_suppkey, s_suppkey, 0 from supplier union select r.root, e.target, r.depth + 1 from r join e on e.source = r.node where r.depth < 5) select distinct root, node from r""")
def edge_reachability(t: Tables) -> DataFrame:
    """Plain edge reachability (not a value-flow analysis)."""
    starts = t.supplier.select(F.col("s_suppkey").alias("root"))
    edges = t.lineitem.select(F.col("l_suppkey").alias("source"), ((F.col("l_suppkey") + F.col("l_partkey") % 3) % t.n_paths).alias("target"), F.lit(0).alias("ord")).distinct()
    return graph.walk(edges, starts, max_depth=5, fan_out=1 << 30).select("root", "node")


@query("SNK-2", """select 0 part, s_suppkey::bigint a, null::bigint b, '  "' || s_suppkey::varchar || '" [label="' || s_name || '"];' line from supplier
    union all select 1, source, target, '  "' || source::varchar || '" -> "' || target::varchar || '" [color="' || case when source = target then 'gray' else 'black' end || '"];' from v_edges""")
def dot_export(t: Tables) -> DataFrame:
    nodes = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"))
    edges = t.edges().withColumn("provider", F.when(F.col("source") == F.col("target"), "file_range").otherwise("lsp_call_hierarchy"))
    return sinks.dot_lines(nodes, edges)


@query("LG-21", "select finding_id, line, coalesce(m.method_id, 'file:' || f.path) symbol, case when m.method_id is null then 'fallback' else 'flow' end route from (select distinct finding_id, line, path, path_id from v_findings) f left join (select path_id, start, min_by(method_id, p_partkey) method_id from v_methods group by 1, 2) m on f.path_id = m.path_id and f.line = m.start")
def symbol_provenance(t: Tables) -> DataFrame:
    f = t.findings().select("finding_id", "line", "path", "path_id").distinct()
    m = rows.first_by(t.methods(), ["path_id", "start"], F.col("p_partkey")).select("path_id", F.col("start").alias("line"), "method_id")
    return f.join(m, ["path_id", "line"], "left").select("finding_id", "line", F.coalesce("method_id", F.concat(F.lit("file:"), F.col("path"))).alias("symbol"), F.when(F.col("method_id").isNull(), "fallback").otherwise("flow").alias("route"))
