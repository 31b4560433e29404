"""Queries over texts, paths and parsed answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import joins, texts, views
from ..sources import code
from .adapters import Tables
from .registry import query


@query("FN-3", "select doc_id, case when length(text) = 0 then 0 else trunc(length(regexp_replace(text, '[^\\x{2e80}-\\x{9fff}\\x{ac00}-\\x{d7af}]', '', 'g')) * 0.9::double + (length(text) - length(regexp_replace(text, '[^\\x{2e80}-\\x{9fff}\\x{ac00}-\\x{d7af}]', '', 'g'))) / 4.0::double)::bigint + 1 end tokens from documents")
def token_estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", scalars.estimate_tokens(F.col("text")).alias("tokens"))


@query("FN-4", "select doc_id, (strlen(text) + 1) // 2 tokens from documents")
def byte_token_estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", scalars.estimate_byte_tokens(F.col("text")).alias("tokens"))


@query("FN-5", "select doc_id, left(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 160) snippet from documents")
def snippets(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", scalars.snippet(F.col("text")).alias("snippet"))


@query("FN-6", "select doc_id, left(array_to_string(string_split(text, chr(10))[1:3], chr(10)), 500) shown, length(array_to_string(string_split(text, chr(10))[1:3], chr(10))) > 500 cut_chars, len(string_split(text, chr(10))) > 3 cut_lines from documents")
def clamped_texts(t: Tables) -> DataFrame:
    c = scalars.clamp_text(F.col("text"), 500, 3)
    return t.documents.select("doc_id", c["text"].alias("shown"), c["cut_chars"].alias("cut_chars"), c["cut_lines"].alias("cut_lines"))


@query("FN-7 FN-12 FN-2", "select doc_id, substr(sha1(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+$', '') || chr(10)), 1, 20) content from documents where trim(text) <> ''")
def canonical_bodies(t: Tables) -> DataFrame:
    return t.documents.filter("trim(text) != ''").select("doc_id", scalars.content_hash(scalars.canonical_body(F.col("text"))).alias("content"))


@query("FN-11 TX-9", """select doc_id, case when len(l) < 2 then '' else array_to_string(l[2:4], chr(10)) end lines, len(l) total, case when len(l) > 4 then 5 end next_offset from (select doc_id, string_split(text, chr(10)) l from documents)""")
def windowed_read(t: Tables) -> DataFrame:
    """Lines 2 to 4 of every document, its lines, and where a next read goes on."""
    window = scalars.windowed(F.col("text"), F.lit(2), F.lit(3))
    return t.documents.select("doc_id", window.alias("w")).select("doc_id", F.array_join("w.lines", "\n").alias("lines"), F.col("w.total").alias("total"), F.col("w.next_offset").alias("next_offset"))


@query("FN-13", "select p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || '-' || p_brand)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') slug from part")
def slugs(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", scalars.slug(F.concat_ws("-", "p_name", "p_brand")).alias("slug"))


@query("FN-14", """select p_partkey, case p_partkey % 8 when 0 then 'sql_injection' when 1 then 'nosql_injection' when 2 then 'xss' when 3 then 'code_injection' when 4 then 'other' when 5 then 'ssrf' when 6 then 'strange_thing' else 'path_traversal' end name from part""")
def type_normalise(t: Tables) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ["SQL Injection", "NoSQL query", "Cross-Site Scripting", "some injection", "  ", "Server side request", "Strange thing!", "directory traversal"])), (F.col("p_partkey") % 8 + 1).cast("int"))
    return t.part.select("p_partkey", scalars.vulnerability_type(raw).alias("name"))


@query("PRJ-11", "select p_partkey, lower(replace(p_type, ' ', '_')) like '%steel%' or lower(replace(p_type, ' ', '_')) like '%tin%' taint from part")
def taint_predicate(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", views.tainted(F.col("p_type"), ["steel", "tin"]).alias("taint"))


@query("PRJ-13", "select p_partkey, p_name from part where p_name not like '%<%'")
def synthetic_filter(t: Tables) -> DataFrame:
    return views.named(t.part, "p_name").select("p_partkey", "p_name")


@query("FN-15", "select p_partkey, array_to_string(list_filter(string_split(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''), '|') words from part")
def words_split(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(scalars.words(F.lower(F.concat_ws(" ", "p_name", "p_brand"))), "|").alias("words"))


@query("FN-16", """select page_id, case page_id % 6 when 0 then 'web-route' when 1 then 'service-layer' when 2 then 'data-access' when 3 then null when 4 then null else 'config' end role,
    case page_id % 6 when 0 then 'shop/controllers' when 1 then 'service' when 2 then 'x' when 3 then '' when 4 then '' else 'config' end "group" from pages""")
def role_of_path(t: Tables) -> DataFrame:
    paths = ["src/main/java/shop/controllers/Cart.java", "app/service/impl/Run.py", "x/user_dao.py", "Work/TaskConsumer.go", "a/OrderRequestDTO.java", "lib/config/x.yml"]
    role = scalars.role_of_path(F.element_at(F.array(*map(F.lit, paths)), (F.col("page_id") % 6 + 1).cast("int")))
    return t.pages.select("page_id", role["role"].alias("role"), role["group"].alias("group"))


@query("FN-8", """with f as (select page_id, regexp_extract(url, '://[^/]+/([^?#]*)', 1) rest from pages), inv as (select distinct regexp_extract(rest, '^[a-z]+/(.*)$', 1) p from f where page_id % 2 = 0 and rest like '%/%')
    select page_id, rest, case when rest in (select p from inv) then rest when regexp_extract(rest, '^[^/]*/(.*)$', 1) in (select p from inv) and rest like '%/%' then regexp_extract(rest, '^[^/]*/(.*)$', 1) end rebased from f""")
def path_rebase(t: Tables) -> DataFrame:
    """A path's longest suffix (at a slash) that the inventory has."""
    f = t.pages.select("page_id", F.regexp_extract("url", "://[^/]+/([^?#]*)", 1).alias("rest"))
    inventory = f.filter("page_id % 2 = 0").filter(F.contains("rest", F.lit("/"))).select(F.regexp_extract("rest", "^[a-z]+/(.*)$", 1).alias("p")).distinct()
    return f.join(code.rebased(f, inventory, "page_id", "rest", "p"), "page_id", "left").select("page_id", "rest", "rebased")


@query("FN-9", "select page_id, replace(replace(url, 'https://', ''), 'http://', '') bare, length(url) units from pages")
def uri_codec(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_replace("url", "^https?://", "").alias("bare"), scalars.utf16_length(F.col("url")).alias("units"))


@query("FN-17 FN-34", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') shown, case substr(o_orderpriority, 3) when 'URGENT' then 'urgent!' else substr(o_orderpriority, 3) end label from orders")
def display_labels(t: Tables) -> DataFrame:
    name = F.substring("o_orderpriority", 3, 99)
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("shown"), F.coalesce(scalars.lookup(name, {"URGENT": "urgent!"}), name).alias("label"))


@query("FN-19 FN-20 FN-23", """select p_partkey, case p_partkey % 4 when 0 then 1.0::double when 1 then 0.85 when 2 then 0.6 end verdict, case p_partkey % 4 when 0 then 0.85::double when 1 then 0.85 when 2 then 0.0 else 0.0 end harness from part""")
def verdict_parse(t: Tables) -> DataFrame:
    case = F.col("p_partkey") % 4
    number, text = F.when(case == 0, F.lit(85.0)), F.when(case == 1, "85").when(case == 2, "0.6 (medium)")
    return t.part.select("p_partkey", scalars.verdict_confidence(number, text).alias("verdict"), scalars.harness_confidence(number, text).alias("harness"))


@query("FN-21", "select o_orderkey, case o_orderkey % 3 when 0 then 'high' when 1 then null else 'critical' end level, case o_orderkey % 3 when 0 then '(needs login)' when 1 then '' else '' end rest from orders")
def leading_enum(t: Tables) -> DataFrame:
    raw = F.element_at(F.array(F.lit("High (needs login)"), F.lit("Highest"), F.lit("critical")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    parsed = scalars.leading_severity(raw)
    return t.orders.select("o_orderkey", parsed["level"].alias("level"), parsed["rest"].alias("rest"))


@query("FN-22 FN-24", "select event_id, props body from events where props like '{%}'")
def json_objects(t: Tables) -> DataFrame:
    answer = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```\nDone {x}"))
    return t.events.filter(F.col("props").like("{%}")).select("event_id", scalars.json_object(answer).alias("body"))


@query("FN-25 FN-26 FN-31", "select event_id, coalesce((props::json ->> '$.cached')::int, (props::json ->> '$.k')::int) usage, case when (props::json ->> '$.k')::int > 0 then (props::json ->> '$.k')::int end line from events")
def usage_normalised(t: Tables) -> DataFrame:
    usage = views.normalised_usage(F.col("props"), (("k",), ("none",), ("cached", "k")))
    return t.events.select("event_id", usage[2].alias("usage"), views.positive_line(F.get_json_object("props", "$.k")).alias("line"))


@query("FN-27", """select n_nationkey, '{"a":"' || n_name || '","b":"' || n_regionkey::varchar || '"}' canonical from nation""")
def canonical_json(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", scalars.sorted_json(F.create_map(F.lit("b"), F.col("n_regionkey").cast("string"), F.lit("a"), F.col("n_name"))).alias("canonical"))


@query("FN-29", "select p_partkey, 'x: int|y|args|' || replace(lower(p_brand), '#', '') names from part")
def parameter_lists(t: Tables) -> DataFrame:
    line = F.concat(F.lit("def run(self, x: int, y=3, *args, "), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.lit("):"))
    return t.part.select("p_partkey", F.array_join(scalars.parameters(line), "|").alias("names"))


@query("FN-32 ST-6", "select p_partkey, 'a/b.py|c' || p_size::varchar || '.java' files from part")
def path_set(t: Tables) -> DataFrame:
    own = F.array(F.lit("a/b.py"))
    text = F.concat(F.lit("see a/b.py and c"), F.col("p_size").cast("string"), F.lit(".java, then a/b.py"))
    return t.part.select("p_partkey", F.array_join(F.array_distinct(F.concat(own, scalars.file_mentions(text))), "|").alias("files"))


@query("FN-33", "select event_id, case when event_type = 'error' then 'it failed' when event_type like '%view%' then 'seen' else 'unknown' end message from events")
def failure_explanation(t: Tables) -> DataFrame:
    return t.events.select("event_id", scalars.first_rule(F.col("event_type"), [("error", "it failed"), ("view", "seen")], "unknown").alias("message"))


@query("ST-3 ST-5", "select p_partkey, array_to_string(list_filter([lower(p_brand), 'x'], lambda v: v <> 'brand#11'), '|') fresh from part")
def new_facts(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(joins.fresh_facts(F.array(F.lower("p_brand"), F.lit("x")), F.array(F.lit("brand#11"))), "|").alias("fresh"))


@query("TX-7", "select doc_id, n line_no, left(trim(line), 400) line from (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) n from documents) where regexp_matches(line, 'token = \"[0-9a-f]+\"')")
def grep_lines(t: Tables) -> DataFrame:
    return code.grep(t.documents, "doc_id", "text", 'token = "[0-9a-f]+"')


@query("TX-10 SRC-4 SRC-5 SRC-6", "select page_id, case when html like '%<script%' then 'script' when html like '%<nav%' then 'nav' when html like '%<p%' then 'p' else 'none' end marker from pages")
def entry_markers(t: Tables) -> DataFrame:
    return t.pages.select("page_id", views.entry_marker(F.col("html"), [("<script", "script"), ("<nav", "nav"), ("<p", "p")], "none").alias("marker"))


@query("TX-1")
def call_sites(t: Tables) -> DataFrame:
    texts = t.documents.select("doc_id", F.regexp_replace("text", r"(\w+), (\w+)", "$1($2)").alias("text"))
    return code.call_sites(texts, "doc_id", "text")


@query("TX-13", "with r as (select source, doc_id // 1024 range, sha1(string_agg(doc_id::varchar || chr(0) || sha1(text) || chr(0), '' order by doc_id)) h from documents group by 1, 2) select source, substr(sha1(string_agg(range::varchar || chr(0) || h || chr(0), '' order by range)), 1, 16) digest from r group by source")
def workspace_digest(t: Tables) -> DataFrame:
    return texts.tree_digests(t.documents.select("source", "doc_id", F.sha1("text").alias("hash")), "source", "doc_id", "hash")


@query("TX-14 SO-4 PRJ-16 JN-15", "select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) prompt from conversations group by conv_id")
def prompt_rendering(t: Tables) -> DataFrame:
    c = t.conversations.withColumn("line", F.concat("role", F.lit(": "), "text"))
    return views.rendered(c, "conv_id", "turn", text="line")


@query("LG-22 TX-8", "select page_id, url not like '%..%' inside from pages")
def confinement(t: Tables) -> DataFrame:
    return t.pages.select("page_id", scalars.clean_path(F.col("url")).isNotNull().alias("inside"))
