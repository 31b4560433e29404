"""Queries over the sources, sinks, code scopes and answers, fed from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import answers, scalars
from ..operators import tools, totals
from ..operators.store import materialised, scratch
from ..sources import code, records, sarif, sinks
from .adapters import Tables
from .registry import query


@query("SRC-1 SRC-2 SRC-3", """select 'R' || (o_orderkey % 3)::varchar "rule", case o_orderkey % 3 when 0 then 'error' when 1 then 'note' else 'warning' end severity, 'src/' || o_custkey::varchar || '.py' path, (o_orderkey % 50)::int start_line,
    'F-' || substr(sha1('R' || (o_orderkey % 3)::varchar || chr(0) || 'src/' || o_custkey::varchar || '.py' || chr(0) || (o_orderkey % 50)::varchar || chr(0) || '3' || chr(0)), 1, 12) finding_id from orders where o_orderkey % 5 <> 0""")
def sarif_findings(t: Tables) -> DataFrame:
    """A document a customer; results without a location are left out, and severities come from level, rule or tag."""
    o = t.orders
    uri = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("src/"), F.col("o_custkey").cast("string"), F.lit(".py")))
    place = F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), F.struct((F.col("o_orderkey") % 50 + 1).cast("int").alias("startLine"), F.lit(4).alias("startColumn")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.concat(F.lit("R"), (F.col("o_orderkey") % 3).cast("string")).alias("ruleId"), F.array(place).alias("locations"))
    docs = o.groupBy("o_custkey").agg(F.to_json(F.collect_list(result)).alias("results"))
    rules = '[{"id":"R0","properties":{"tags":["x","critical"]}},{"id":"R1","defaultConfiguration":{"level":"note"}},{"id":"R2"}]'
    text = F.concat(F.lit('{"runs":[{"tool":{"driver":{"name":"t","rules":' + rules + '}},"results":'), F.col("results"), F.lit("}]}"))
    found = sarif.projected(sarif.from_texts(docs.select(F.col("o_custkey").cast("string").alias("file"), text.alias("text"))))
    return found.select("rule", "severity", "path", "start_line", "finding_id")


@query("SRC-8", "select count(*) filter (where event_id % 10 <> 0) rows_read, count(*) filter (where event_id % 10 = 0) damaged, sum(case when event_id % 10 <> 0 then event_id end)::bigint seqs from events")
def jsonl_damage(t: Tables) -> DataFrame:
    whole = F.to_json(F.struct(F.col("event_id").alias("seq"), F.col("event_type").alias("kind")))
    lines = t.events.select(F.when(F.col("event_id") % 10 == 0, F.substring(whole, 1, 9)).otherwise(whole).alias("value"))
    rows = records.parsed_lines(lines, StructType.fromDDL("seq long, kind string"))
    return rows.agg(F.count_if(~F.col("damaged")).alias("rows_read"), F.count_if("damaged").alias("damaged"), F.sum("seq").alias("seqs"))


@query("SRC-7", "select doc_id, doc_id % 7 = 0 is_binary, case when doc_id % 7 <> 0 then length(text) end n from documents")
def file_states(t: Tables) -> DataFrame:
    content = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("a\0b").cast("binary"), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))
    got = records.texts(t.documents.select(F.col("doc_id").alias("path"), content.alias("content")))
    return got.select(F.col("path").alias("doc_id"), (F.col("state") == "binary").alias("is_binary"), F.length("text").alias("n"))


@query("SRC-16", "select p_partkey, p_brand name, '' parent from part union all select p_partkey, 'f' || p_size::varchar, p_brand from part where p_size > 25")
def symbols_flat(t: Tables) -> DataFrame:
    span = '"range":{"start":{"line":1,"character":0},"end":{"line":2,"character":0}}'
    child = F.when(F.col("p_size") > 25, F.concat(F.lit(',"children":[{"name":"f'), F.col("p_size").cast("string"), F.lit(f'","kind":6,{span}}}]'))).otherwise("")
    payload = F.concat(F.lit('[{"name":"'), F.col("p_brand"), F.lit(f'","kind":5,{span}'), child, F.lit("}]"))
    got = records.symbols(t.spark, t.part.select(F.col("p_partkey").alias("path"), payload.alias("payload")))
    return got.select(F.col("path").alias("p_partkey"), "name", "parent")


@query("SRC-17", "select l_suppkey::varchar report, l_linenumber::int flow, count(*) elements from lineitem where l_quantity > 3 group by 1, 2")
def flow_report(t: Tables) -> DataFrame:
    line = F.concat_ws("\t", F.when(F.col("l_quantity") > 3, "ELEM").otherwise("NOTE"), F.col("l_linenumber").cast("string"), F.lit("CALL"), F.lit("f"), F.lit("a.py"), F.lit("?"), F.lit("x"))
    report = t.lineitem.groupBy(F.col("l_suppkey").cast("string").alias("report")).agg(F.array_join(F.collect_list(line), "\n").alias("value"))
    return records.flow_elements(report).select("report", "flow", F.size("elements").cast("long").alias("elements"))


@query("SNK-1 SNK-3", "select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey")
def package_round_trip(t: Tables) -> DataFrame:
    root = scratch(t.spark, "package")
    sinks.package({"nation": t.nation, "region": t.region}, root)
    nation, region = (t.spark.read.schema(df.schema).json(f"{root}/{n}") for n, df in (("nation", t.nation), ("region", t.region)))
    return materialised(nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name"))


@query("SNK-6", "select event_id, case when event_type in ('view', 'click') then event_type else 'unknown' end kind, case when event_type not in ('view', 'click') then event_type end raw_kind from events")
def known_kinds(t: Tables) -> DataFrame:
    return sinks.known_kinds(t.events.select("event_id", F.col("event_type").alias("kind")), ["view", "click"])


@query("SNK-9", "select '| ' || r_name || ' | ' || count(*)::varchar || ' |' line from nation join region on n_regionkey = r_regionkey group by r_name")
def report_lines(t: Tables) -> DataFrame:
    n = totals.histogram(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")), "r_name")
    return sinks.table_lines(n.select("r_name", "n"))


def code_files(t: Tables) -> DataFrame:
    """A Python and a Java file a part, with nested and following functions."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    py = F.concat(F.lit("import x\n\nclass A:\n    @deco\n    def f"), size, F.lit("(self, a):\n        def inner():\n            return 1\n        return g(a)\n\n\ndef g(a):\n    return a\n"))
    java = F.concat(F.lit("class A {\n  int h"), size, F.lit("(int a) {\n    return g(a);\n  }\n}\n"))
    return t.part.select(F.concat(F.lit("p"), key, F.lit(".py")).alias("path"), py.alias("text")).unionByName(t.part.select(F.concat(F.lit("p"), key, F.lit(".java")).alias("path"), java.alias("text")))


@query("TX-2 TX-3 UD-7", """select 'p' || p_partkey::varchar || '.py' path, 'f' || p_size::varchar "name", 3 "start", 7 "end", 'A' owner from part union all select 'p' || p_partkey::varchar || '.py', 'g', 10, 11, null from part
    union all select 'p' || p_partkey::varchar || '.java', 'h' || p_size::varchar, 1, 3, null from part""")
def method_scopes(t: Tables) -> DataFrame:
    return code.methods(code_files(t), "path", "text")


@query("TX-1 TX-4 JN-1", """select 'p' || p_partkey::varchar || '.py' path, 'f' || p_size::varchar caller, 'g' callee, 8 line_no from part union all select 'p' || p_partkey::varchar || '.java', 'h' || p_size::varchar, 'g', 3 from part""")
def scoped_calls(t: Tables) -> DataFrame:
    return code.innermost_calls(code_files(t)).select("path", "caller", "callee", "line_no")


@query("SO-12", """with p as (select user_id, event_id, row_number() over (order by ts, event_id) n from events where event_type = 'signup') select user_id, event_id, (n - 1) // 40 batch from p""")
def lead_batches(t: Tables) -> DataFrame:
    from ..operators import rows

    leads = t.events.filter("event_type = 'signup'").select("user_id", "event_id", "ts")
    return rows.chunked(leads, 40, F.col("ts"), F.col("event_id")).select("user_id", "event_id", F.col("chunk").alias("batch"))


@query("SM-13", "select p_partkey, case when p_size % 5 <> 0 then (100 // (p_size % 5))::varchar end result, p_size % 5 = 0 failed from part")
def isolated_failures(t: Tables) -> DataFrame:
    got = answers.isolated(t.part.select("p_partkey", F.col("p_size").cast("string").alias("v")), "p_partkey", "v", lambda v: str(100 // (int(v) % 5)))
    return got.select("p_partkey", "result", F.col("error").isNotNull().alias("failed"))


@query("FN-24 LG-24", "select event_id, 1 calls, (props::json ->> '$.k')::int \"first\", 1 k, null::varchar tail from events")
def truncated_json(t: Tables) -> DataFrame:
    cut = F.concat(F.lit('text {"calls": ['), F.col("props"), F.lit('], "k": 1, "tail": "unfin'))
    read = F.from_json(answers.repair(cut), "calls array<map<string,string>>, k int, tail string")
    return t.events.select("event_id", read.alias("r")).select("event_id", F.size("r.calls").alias("calls"), F.col("r.calls")[0]["k"].cast("int").alias("first"), F.col("r.k").alias("k"), F.col("r.tail").alias("tail"))


@query("LG-24", "select event_id, least(event_id % 12, 8)::int n_calls from events")
def turn_calls(t: Tables) -> DataFrame:
    many = F.transform(F.slice(F.sequence(F.lit(1), F.lit(12)), 1, (F.col("event_id") % 12).cast("int")), lambda i: F.concat(F.lit('{"tool":"grep","arguments":{"n":"'), i.cast("string"), F.lit('"}}')))
    answer = F.concat(F.lit('{"calls":['), F.array_join(many, ","), F.lit("]}"))
    return t.events.select("event_id", F.size(answers.calls(answer)).alias("n_calls"))


@query("UD-4", "select l_orderkey, l_linenumber, l_partkey, case when l_quantity < 5 then 'error' when l_quantity < 20 then 'fallback' when l_quantity < 30 then 'no_path' else 'flow' end outcome from lineitem")
def dataflow_verify(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    bundle = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (q >= 5).alias("sink"), F.when(q >= 20, F.lit(3)).otherwise(F.lit(1)).alias("sources"), (q >= 20).alias("answered"), F.when(q >= 30, 1).otherwise(0).alias("flows"))
    return bundle.select("l_orderkey", "l_linenumber", "l_partkey", scalars.dataflow_outcome(F.col("sink"), F.col("sources"), F.col("answered"), F.col("flows")).alias("outcome"))


@query("PRJ-4 AG-1", "select p_brand, count(*) n, max(case p_partkey % 3 when 0 then 1 when 1 then 2 else 4 end) worst from part group by 1")
def worst_trust(t: Tables) -> DataFrame:
    provider = F.element_at(F.array(F.lit("lsp_call_hierarchy"), F.lit("lsp_references"), F.lit("joern_dataflow")), (F.col("p_partkey") % 3 + 1).cast("int"))
    from ..functions import fixed

    return t.part.groupBy("p_brand").agg(F.count("*").alias("n"), F.max(scalars.lookup(scalars.trust(provider), fixed.TRUST_RANK)).alias("worst"))


@query("IV-10")
def material_packet(t: Tables) -> DataFrame:
    """A candidate a part, in its Python file, with a path through its Java file and back."""
    from ..operators import material

    key = F.col("p_partkey").cast("string")
    path = F.array(F.concat(F.lit("p"), key, F.lit(".java:3 g")), F.concat(F.lit("p"), key, F.lit(".py:12")), F.concat(F.lit("q"), key, F.lit(".py:1")))
    found = t.part.select(F.col("p_partkey").alias("candidate_id"), F.concat(F.lit("p"), key, F.lit(".py")).alias("file"), F.lit(8).alias("line"), path.alias("path"))
    return material.packets(found, code_files(t)).drop("text")


@query("UD-1", """select p_partkey call_id, p_size % 3 <> 0 ok, case when p_size % 3 = 0 then 'missing: path' else '2 of 6 lines' end summary, case when p_size % 3 = 0 then '[]' else '["  int h' || p_size::varchar || '(int a) {","    return g(a);"]' end as "data", p_size % 3 <> 0 truncated from part""")
def tool_reads(t: Tables) -> DataFrame:
    """A read of every part's Java file, a third of them without a path."""
    path = F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".java"))
    given = F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("limit"), F.lit("2"))).otherwise(F.create_map(F.lit("path"), path, F.lit("offset"), F.lit("2"), F.lit("limit"), F.lit("2")))
    return tools.call("read", code_files(t), t.part.select(F.col("p_partkey").alias("call_id"), given.alias("arguments")))


@query("UD-5 UD-8", "select p_partkey, case when p_size % 5 <> 0 then (100 // (p_size % 5))::varchar end answer, case when p_size % 5 = 0 then 3 else 1 end::int attempts, p_size % 5 = 0 failed from part")
def provided_answers(t: Tables) -> DataFrame:
    """An injected provider that fails for some contexts, however often it is asked."""
    got = tools.provided(t.part.select("p_partkey", F.col("p_size").cast("string").alias("v")), "p_partkey", "v", lambda v: str(100 // (int(v) % 5)))
    return got.select("p_partkey", "answer", "attempts", F.col("error").isNotNull().alias("failed"))


@query("SRC-11", """select 'b' || o_orderkey::varchar bundle_id, o_orderstatus created_at, case when o_orderkey % 7 = 0 then 'unreadable' end error, case when o_orderkey % 7 <> 0 then o_orderkey % 4 end::int prune_count from orders where o_orderkey % 5 <> 0""")
def bundle_list(t: Tables) -> DataFrame:
    """Manifests of orders: a fifth is still being written, a seventh can't be read."""
    n = F.when(F.col("o_orderkey") % 7 != 0, F.sequence(F.lit(1), F.lit(4)))
    o = t.orders.select(F.concat(F.when(F.col("o_orderkey") % 5 == 0, ".b").otherwise("b"), F.col("o_orderkey").cast("string")).alias("folder"), F.col("o_orderstatus").alias("created_at"), F.when(F.col("o_orderkey") % 7 == 0, "unreadable").alias("error"), F.slice(n, F.lit(1), (F.col("o_orderkey") % 4).cast("int")).alias("prunes"))
    return records.listed_bundles(o).select("bundle_id", "created_at", "error", "prune_count")


@query("SRC-13", "select o_orderkey::varchar folder, o_orderstatus created_at from orders where o_orderkey % 7 <> 0 and o_orderkey % 5 <> 0")
def project_registry(t: Tables) -> DataFrame:
    """Records of projects without damaged and half-written ones."""
    o = t.orders.select(F.concat(F.when(F.col("o_orderkey") % 5 == 0, ".staging-").otherwise(""), F.col("o_orderkey").cast("string")).alias("folder"), F.col("o_orderstatus").alias("created_at"), F.when(F.col("o_orderkey") % 7 == 0, "unreadable").alias("error"))
    return records.registered_projects(o)


@query("SRC-12 JN-15", "select conv_id, turn, coalesce(turn <= 1 and conv_id % 2 = 0, false) in_prefix from conversations")
def prompt_block_scan(t: Tables) -> DataFrame:
    """Turns as blocks; every second conversation has a prefix document that names the first two."""
    blocks = t.conversations.select(F.col("conv_id").alias("bundle"), F.col("turn").cast("string").alias("block_id"), "turn")
    prefix = t.conversations.filter("conv_id % 2 = 0").select(F.col("conv_id").alias("bundle")).distinct().withColumn("prefix_blocks", F.array(F.lit("0"), F.lit("1")))
    return records.prompt_blocks(blocks, prefix).select(F.col("bundle").alias("conv_id"), "turn", "in_prefix")


@query("SNK-6 SNK-7 SNK-8", "select event_id, event_id - (select min(event_id) from events) + 101 seq, case when event_type in ('view', 'click') then event_type else 'unknown' end kind from events")
def trail_sink(t: Tables) -> DataFrame:
    """Events appended to a trail after seq 100, read back."""
    path = scratch(t.spark, "trail")
    sinks.trail(t.events.select("event_id", F.col("event_type").alias("kind")), path, ["view", "click"], 100, F.col("event_id"))
    return t.spark.read.schema("event_id long, seq long, kind string").json(path)


@query("SNK-4", "select event_id call_id, (props::json ->> '$.k')::int % 2 = 0 verdict from events where event_type = 'view' and (props::json ->> '$.k') is not null")
def verdict_sink(t: Tables) -> DataFrame:
    """Calls with a verdict, written as a report and read back."""
    path = scratch(t.spark, "report")
    k = F.get_json_object("props", "$.k").cast("int")
    sinks.verdicts(t.events.select(F.col("event_id").alias("call_id"), F.when(F.col("event_type") == "view", k % 2 == 0).alias("verdict"), F.col("props").alias("answer")), path)
    return t.spark.read.schema("call_id long, verdict boolean").json(f"{path}/verdicts")
