"""Queries over assembled contexts, versions of evidence, inboxes, scopes, definitions, positions and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import batches, contexts, evidence, inbox, merges, scopes, skew, tools
from ..operators.store import materialised
from ..sources import definitions
from .adapters import Tables
from .inputs import code_files
from .registry import query

# --- contexts: an order is a slice around its customer's method; its lines name findings and methods ----------------------
CONTEXTS = """s as (select 'b' || (o_custkey % 5)::varchar bundle, o_orderkey slice, 'm' || o_custkey::varchar focus, 'f' || (o_custkey % 7)::varchar path, (o_custkey % 11)::int line, case when o_orderkey % 3 = 0 then 1 else 0 end syntax from orders),
n as (select s.bundle, s.focus, slice, 'F' || l_orderkey::varchar || '-' || l_linenumber::varchar finding_id, max(l_quantity) over (partition by l_orderkey, l_linenumber) >= 3 there,
  case max(l_returnflag) over (partition by l_orderkey, l_linenumber) when 'R' then 0 when 'A' then 1 else 4 end rank from lineitem join s on l_orderkey = slice),
least as (select bundle, focus, method_id, min(depth) depth from (select s.bundle, s.focus, 'm' || l_partkey::varchar method_id, l_linenumber depth from lineitem join s on l_orderkey = slice union all select bundle, focus, focus, 0 from s) group by 1, 2, 3),
held as (select bundle, focus, count(*) bodies, sum(n - 1)::bigint aliases from (select bundle, focus, p_brand, p_size, count(*) n from least join part on method_id = 'm' || p_partkey::varchar where p_size > 5 group by 1, 2, 3, 4) group by 1, 2),
g as (select bundle, focus, count(*) slices, min_by(syntax, slice) syntax, min_by(path, slice) path, min_by(line, slice) line from s group by 1, 2),
sums as (select bundle, focus, count(*) discoverable, count(*) filter (there) known, min(rank) filter (there) worst, string_agg(finding_id, ',' order by finding_id) filter (there) ids from n group by 1, 2),
m as (select bundle, focus, count(*) methods, string_agg(method_id, ',' order by method_id) ids from least group by 1, 2),
ranked as (select g.*, coalesce(discoverable, 0) discoverable, coalesce(known, 0) known, coalesce(worst, 4) worst, methods, coalesce(bodies, 0) bodies, coalesce(aliases, 0) aliases,
  'C-' || substr(sha1(focus || chr(0) || m.ids || chr(0) || coalesce(sums.ids, '') || chr(0)), 1, 12) context_id from g join m using (bundle, focus) left join sums using (bundle, focus) left join held using (bundle, focus)),
placed as (select *, row_number() over (partition by bundle order by slices desc, syntax, worst, path, line, focus) place from ranked)"""


def slice_tables(t: Tables) -> tuple[DataFrame, ...]:
    """slices, refs, named, findings and bodies."""
    o = t.orders
    bundle = F.concat(F.lit("b"), (F.col("o_custkey") % 5).cast("string")).alias("bundle")
    focus = F.concat(F.lit("m"), F.col("o_custkey").cast("string"))
    slices = o.select(bundle, F.col("o_orderkey").alias("slice"), focus.alias("focus"), F.concat(F.lit("f"), (F.col("o_custkey") % 7).cast("string")).alias("path"), (F.col("o_custkey") % 11).cast("int").alias("line"), F.when(F.col("o_orderkey") % 3 == 0, "syntax_regex").otherwise("lsp_definition").alias("provider"))
    li = t.lineitem.join(o.select("o_orderkey", bundle), F.col("l_orderkey") == F.col("o_orderkey"))
    refs = li.select("bundle", F.col("l_orderkey").alias("slice"), F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("method_id"), F.col("l_linenumber").alias("depth")).unionByName(slices.select("bundle", "slice", F.col("focus").alias("method_id"), F.lit(0).alias("depth")))
    finding = F.concat(F.lit("F"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("finding_id")
    named = li.select("bundle", F.col("l_orderkey").alias("slice"), finding)
    told = li.groupBy("bundle", "l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_returnflag").alias("l_returnflag"))
    findings = told.filter("l_quantity >= 3").select("bundle", finding, F.when(F.col("l_returnflag") == "R", "error").when(F.col("l_returnflag") == "A", "warning").otherwise("odd").alias("severity"))
    five = F.explode(F.array(*[F.lit(f"b{i}") for i in range(5)]))
    bodies = t.part.filter("p_size > 5").select(five.alias("bundle"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("method_id"), F.md5(F.concat("p_brand", F.lit(":"), F.col("p_size").cast("string"))).alias("content_hash"))
    return slices, refs, named, findings, bodies


@query("GR-3 SO-2 AG-6 SO-6", f"with {CONTEXTS} select bundle, focus, context_id, slices, discoverable, known, worst, methods, bodies, aliases, case when place <= 8 then place end place from placed")
def assembled_contexts(t: Tables) -> DataFrame:
    """Contexts around customers' methods; a bundle keeps eight."""
    got = contexts.contexts(*slice_tables(t), max_contexts=8)
    return got.select("bundle", "focus", "context_id", "slices", "discoverable", "known", "worst", "methods", "bodies", "aliases", "place")


@query("GR-3 GR-4", f"with {CONTEXTS} select bundle, focus, min('m' || p_partkey::varchar) method_id, count(*) - 1 aliases from least join part on method_id = 'm' || p_partkey::varchar where p_size > 5 group by bundle, focus, p_brand, p_size")
def context_bodies(t: Tables) -> DataFrame:
    """Which method's body stands in a context, and how many others have the same bytes."""
    slices, refs, _, _, bodies = slice_tables(t)
    return contexts.inlined(materialised(contexts.references(slices, refs)), bodies).select("bundle", "focus", "method_id", F.size("aliases").cast("long").alias("aliases"))


@query("AG-10", f"""with {CONTEXTS} select bundle, sum(discoverable)::bigint discoverable, sum(case when place <= 8 then known else 0 end)::bigint bundled, sum(case when place <= 8 then slices - 1 else 0 end)::bigint deduped,
greatest(0, sum(discoverable) - sum(case when place <= 8 then known else 0 end))::bigint rejected, coalesce(sum(case when place <= 8 then known else 0 end) / nullif(sum(discoverable), 0), 1.0)::double ratio from placed group by 1""")
def context_accounts(t: Tables) -> DataFrame:
    slices, _, named, findings, _ = slice_tables(t)
    return contexts.accounted(contexts.capped(contexts.ranked(slices, named, findings), 8))


@query("JN-3", """select 'C' || o_custkey::varchar context_id, 'F' || l_orderkey::varchar || '-' || l_linenumber::varchar finding_id, case when q >= 3 then case f when 'R' then 'error' when 'A' then 'warning' else 'odd' end end severity, q < 3 missing
from (select *, max(l_quantity) over (partition by l_orderkey, l_linenumber) q, max(l_returnflag) over (partition by l_orderkey, l_linenumber) f from lineitem) join orders on l_orderkey = o_orderkey""")
def context_finding_views(t: Tables) -> DataFrame:
    """Findings that contexts name, with those that aren't there."""
    slices, _, named, findings, _ = slice_tables(t)
    of = named.join(slices.select("bundle", "slice", F.concat(F.lit("C"), F.substring("focus", 2, 99)).alias("context_id")), ["bundle", "slice"])
    return contexts.finding_views(materialised(of.drop("slice")), findings).select("context_id", "finding_id", "severity", "missing")


@query("JN-3", """select 'C' || o_custkey::varchar context_id, coalesce(a.p_name, 'm' || o_custkey::varchar) caller_name, coalesce(b.p_name, 'm' || (l_partkey * 2)::varchar) callee_name, l_linenumber line
from lineitem join orders on l_orderkey = o_orderkey left join part a on a.p_partkey = o_custkey left join part b on b.p_partkey = l_partkey * 2""")
def context_edge_views(t: Tables) -> DataFrame:
    """Calls of contexts by name; half of the callees are no method that is known."""
    li = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    cust = F.col("o_custkey").cast("string")
    edges = li.select(F.lit("b").alias("bundle"), F.concat(F.lit("C"), cust).alias("context_id"), F.concat(F.lit("m"), cust).alias("caller_id"), F.concat(F.lit("m"), (F.col("l_partkey") * 2).cast("string")).alias("callee_id"), F.col("l_linenumber").alias("line"))
    methods = t.part.select(F.lit("b").alias("bundle"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("method_id"), F.col("p_name").alias("name"))
    return contexts.edge_views(edges, methods).select("context_id", "caller_name", "callee_name", "line")


@query("JN-3", """with c as (select distinct 'b' || (o_custkey % 5)::varchar bundle, 'C' || o_custkey::varchar context_id, o_custkey from orders),
own as (select distinct context_id, l_partkey p from lineitem join orders on l_orderkey = o_orderkey join c using (o_custkey) union select context_id, o_custkey from c)
select context_id, p_type "rule", p_partkey prune from own join part on p = p_partkey where p_size < 10
union all select context_id, n_name, n_nationkey from c join nation on bundle = 'b' || (n_nationkey % 5)::varchar""")
def context_prune_views(t: Tables) -> DataFrame:
    """Prunes of a context's methods and focus, and those of its bundle that name no method."""
    key = F.col("o_custkey").cast("string")
    of = t.orders.select("o_orderkey", F.concat(F.lit("b"), (F.col("o_custkey") % 5).cast("string")).alias("bundle"), F.concat(F.lit("m"), key).alias("focus"), F.concat(F.lit("C"), key).alias("context_id"))
    li = t.lineitem.select("l_orderkey", F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("method_id"))
    members = li.join(of, F.col("l_orderkey") == F.col("o_orderkey")).select("bundle", "context_id", "method_id")
    five = F.explode(F.array(*[F.lit(f"b{i}") for i in range(5)]))
    prunes = t.part.filter("p_size < 10").select(five.alias("bundle"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("method_id"), F.col("p_type").alias("rule"), F.col("p_partkey").alias("prune"))
    prunes = prunes.unionByName(t.nation.select(F.concat(F.lit("b"), (F.col("n_nationkey") % 5).cast("string")).alias("bundle"), F.lit(None).cast("string").alias("method_id"), F.col("n_name").alias("rule"), F.col("n_nationkey").cast("long").alias("prune")))
    return contexts.prune_views(of.select("bundle", "context_id", "focus").distinct(), members, prunes).select("context_id", "rule", "prune")


# --- evidence and leads: users are claims and inboxes, their events facts, conclusions and leads ------------------------------
EVIDENCE = """e as (select user_id claim, event_id seq, case event_type when 'signup' then 'candidate' when 'click' then 'verdict' when 'view' then 'path' else 'finding' end kind, (props::json ->> '$.k')::int k from events),
f as (select claim, seq, unnest(['fact ' || (k % 7)::varchar, 'site ' || (k // 20)::varchar]) fact from e where kind = 'candidate'),
bumps as (select distinct claim, seq, 1 bump from (select claim, fact, min(seq) seq from f where fact is not null group by 1, 2) join (select claim, min(seq) begins from e where kind = 'candidate' group by 1) using (claim) where seq > begins),
versions as (select claim, seq, kind, (1 + sum(coalesce(bump, 0)) over (partition by claim order by seq))::bigint version, 1 + coalesce((select count(*) from bumps b where b.claim = e.claim), 0) latest from e left join bumps using (claim, seq)),
states as (select claim, seq, kind, version, case when kind = 'candidate' then null when version = latest then 'current' when kind = 'finding' then 'retracted' else 'history' end status from versions)"""


def evidence_events(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "candidate").when(F.col("event_type") == "click", "verdict").when(F.col("event_type") == "view", "path").otherwise("finding")
    k = F.get_json_object("props", "$.k").cast("int")
    facts = F.array(F.concat(F.lit(" Fact  "), (k % 7).cast("string")), F.concat(F.lit("SITE "), F.floor(k / 20).cast("string")))
    return t.events.select(F.col("user_id").alias("claim"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(kind == "candidate", facts).alias("facts"))


@query("GR-11", f"with {EVIDENCE} select claim, seq, kind, version, status from states")
def evidence_versions(t: Tables) -> DataFrame:
    """New facts about a user make a version; what was concluded before is history or retracted."""
    return evidence.versions(evidence_events(t), "claim")


@query("GR-11", f"""with {EVIDENCE} select claim, max(version) version, count(*) filter (kind = 'verdict' and status = 'current') current_verdicts, count(*) filter (kind = 'verdict' and status = 'history') history_verdicts,
count(*) filter (kind = 'path' and status = 'current') current_paths, count(*) filter (kind = 'path' and status = 'history') history_paths, count(*) filter (kind = 'finding' and status = 'current') current_findings, count(*) filter (kind = 'finding' and status = 'retracted') retracted_findings from states group by 1""")
def evidence_state(t: Tables) -> DataFrame:
    return evidence.state(evidence.versions(evidence_events(t), "claim"), "claim")


MILLIS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
DAY, HOUR = 86_400_000, 3_600_000


def decide(leads: list[dict]) -> list[dict]:
    """A planner that dismisses every third lead and links the others."""
    return [{"lead_id": v["lead_id"], "action": "dismiss" if int(v["lead_id"]) % 3 == 0 else "link", "reason": "known"} for v in leads]


@query("SM-11", f"""with recursive l as (select user_id, list(epoch_us(ts) // 1000 order by ts, event_id) ats, list(event_id order by ts, event_id) ids from events where event_type = 'signup' group by 1),
c as (select user_id, ats, ids, 0 "call", 0 done, 0 took, 0::bigint "at" from l
union all select user_id, ats, ids, "call" + 1, done + took, least(3, len([x for x in ats if x < t]) - done - took)::int, t from (select *, case when "call" = 0 or ats[done + took + 1] + {2 * DAY} > "at" then ats[done + took + 1] + {2 * DAY} else "at" + {6 * HOUR} end t from c where done + took < len(ats) and "call" < 12))
select user_id, "call", "at", unnest(ids[done + 1 : done + took]) lead_id, case when unnest(ids[done + 1 : done + took]) % 3 = 0 then 'dismissed' else 'linked' end status from c where "call" > 0""")
def inbox_plans(t: Tables) -> DataFrame:
    """Signups as leads of users: planned when the oldest has waited two days, three at a time, twelve times at most."""
    leads = t.events.filter("event_type = 'signup'").select("user_id", F.expr(MILLIS).alias("at"), F.col("event_id").alias("seq"), F.lit("lead").alias("kind"), F.col("event_id").cast("string").alias("lead_id"), F.lit("").alias("text"))
    got = inbox.planned(leads, "user_id", decide, wait=2 * DAY, interval=6 * HOUR, most=3, budget=12)
    return got.filter("lead_id is not null").select("user_id", "call", "at", F.col("lead_id").cast("long").alias("lead_id"), "status")


@query("SM-2 SM-9", """with o as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_extendedprice) n from lineitem),
e as (select l_orderkey job_id, n, (n * 60 + trunc(l_quantity))::bigint "at", l_returnflag = 'N' and n = max(n) over (partition by l_orderkey) ends from o),
g as (select *, lead("at") over (partition by job_id order by n) later from e),
silent as (select job_id, min(n) n from g where not ends and (later is null or later - "at" >= 70) group by 1),
lost as (select g.job_id, g."at" from silent join g using (job_id, n))
select job_id, "at" + 70 "at", 'running' state, 'b' consumer, 2 attempt from lost union all select job_id, "at" + 140, 'failed', null, 2 from lost union all select job_id, "at" + 640, 'expired', null, 0 from lost
union all select job_id, "at", 'succeeded', 'a', 1 from g where ends and job_id not in (select job_id from lost) union all select job_id, "at" + 500, 'expired', null, 0 from g where ends and job_id not in (select job_id from lost)
union all select job_id, "at", 'queued', null, 0 from e where n = 1 union all select job_id, "at", 'running', 'a', 1 from e where n = 1""")
def job_takeovers(t: Tables) -> DataFrame:
    """Orders as jobs whose lines are beats: a claim that is silent for 70 goes to the other consumer and then fails; ended jobs
    expire after 500. Whether a job ends isn't known where its last line has no flag."""
    of = Window.partitionBy("l_orderkey")
    lines = skew.dealt(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag"), "l_orderkey").withColumn("n", F.row_number().over(of.orderBy(*(F.col(c).asc_nulls_last() for c in ("l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag"))))).withColumn("last", F.count("*").over(of))
    at = (F.col("n") * 60 + F.col("l_quantity").cast("long")).cast("long").alias("at")
    li = lines.select(F.col("l_orderkey").alias("job_id"), at, "n", ((F.col("l_returnflag") == "N") & (F.col("n") == F.col("last"))).alias("ends"))
    first = F.array(F.lit("submitted"), F.lit("claimed"))
    end = F.array(F.when(F.col("ends"), "succeeded").otherwise("unknown"))
    open_ = F.coalesce(~F.col("ends"), F.lit(False))
    kinds = F.when((F.col("n") == 1) & open_, first).when(F.col("n") == 1, F.concat(first, end)).when(open_, F.array(F.lit("beat"))).otherwise(end)
    events = li.select("job_id", "at", "n", F.posexplode(kinds).alias("i", "kind")).select("job_id", "at", (F.col("n") * 10 + F.col("i")).alias("seq"), "kind", F.when(F.col("kind") != "submitted", "a").alias("consumer"))
    return inbox.held(events, "job_id", ["a", "b"], visibility=70, ttl=500, order=("seq",))


# --- scopes ---------------------------------------------------------------------------------------------------------------
PAGE_FILES = """p as (select page_id, regexp_extract(url, '([a-z]+\\.[a-z]+)/', 1) site, regexp_extract(url, '\\.[a-z]+/([a-z]+)/', 1) lang, regexp_extract(url, '/([0-9]+)', 1)::int n from pages),
d as (select page_id, site, lang, n, case n % 7 when 0 then 'controllers' when 1 then 'services' when 2 then 'dao' when 3 then 'config' else 'pages' end dir, case n % 5 when 0 then '.py' when 1 then '.java' when 2 then '.yml' when 3 then '.txt' else '.xml' end suffix from p),
k as (select *, case n % 7 when 0 then 'web-route' when 1 then 'service-layer' when 2 then 'data-access' end "role" from d where suffix <> '.txt')"""


def page_files(t: Tables) -> DataFrame:
    """Pages as files of their site: the number in the url picks a folder and a suffix."""
    n = F.regexp_extract("url", "/([0-9]+)", 1).cast("int")
    folder = F.when(n % 7 == 0, "controllers").when(n % 7 == 1, "services").when(n % 7 == 2, "dao").when(n % 7 == 3, "config").otherwise("pages")
    suffix = F.when(n % 5 == 0, ".py").when(n % 5 == 1, ".java").when(n % 5 == 2, ".yml").when(n % 5 == 3, ".txt").otherwise(".xml")
    return t.pages.select("page_id", F.regexp_extract("url", r"([a-z]+\.[a-z]+)/", 1).alias("site"), F.concat(F.lit("src/"), F.regexp_extract("url", r"\.[a-z]+/([a-z]+)/", 1), F.lit("/"), folder, F.lit("/"), F.lit("p"), F.col("page_id").cast("string"), suffix).alias("path"))


@query("TX-11", f"""with {PAGE_FILES}, g as (select site, case when "role" is not null then 'scope-' || "role" || '-' || lang || '-' || dir when suffix in ('.yml', '.xml') then 'scope-config' else 'scope-root' end scope_id,
coalesce("role", case when suffix in ('.yml', '.xml') then 'config' else 'entrypoint' end) kind, case when "role" is not null then lang || '/' || dir else '.' end path, case when "role" is not null then 0 when suffix in ('.yml', '.xml') then 1 else 2 end turn, count(*) files from k group by all),
r as (select *, row_number() over (partition by site order by turn, kind, path) place, count(*) over (partition by site) n from g)
select site, scope_id, kind, path, files, place, greatest(n - 6, 0) omitted from r where place <= 6""")
def scope_discovery(t: Tables) -> DataFrame:
    """Scopes of each site's files, six at most."""
    return scopes.discovered(page_files(t), "path", ["site"], limit=6)


@query("LG-19", f"""with {PAGE_FILES}, f as (select site, kind, min(page_id) "at" from (select site, page_id, coalesce("role", case when suffix in ('.yml', '.xml') then 'config' end) kind from k union all select site, page_id, case n % 7 when 0 then 'web-route' when 1 then 'service-layer' when 2 then 'data-access' end from d where suffix = '.txt') where kind is not null group by 1, 2)
select site, string_agg(kind, ',' order by "at") kinds from f group by 1""")
def scope_skills(t: Tables) -> DataFrame:
    """Kinds of each site's files, as they are first met."""
    return scopes.skills(page_files(t), "path", ["site"], "page_id").select("site", F.array_join("kinds", ",").alias("kinds"))


@query("FN-30", f"with {PAGE_FILES} select page_id, case suffix when '.py' then 'python' when '.java' then 'java' else substr(suffix, 2) end \"language\" from d")
def suffix_languages(t: Tables) -> DataFrame:
    return page_files(t).select("page_id", paths.language(F.col("path")).alias("language"))


# --- definitions -------------------------------------------------------------------------------------------------------
@query("TX-12", """with w as (select p_partkey, 'f' || p_size::varchar "name", 'p' || p_partkey::varchar || '.py' path, 5 s, 8 e from part union all select p_partkey, 'inner', 'p' || p_partkey::varchar || '.py', 6, 8 from part
union all select p_partkey, 'g', case when p_size % 2 = 0 then 'p' || p_partkey::varchar || '.py' else (select min('p' || p_partkey::varchar || '.py') from part) end, 11, 12 from part union all select p_partkey, 'nothing', null, null, null from part)
select p_partkey, "name", path, s "start", e "end" from w""")
def definition_lookup(t: Tables) -> DataFrame:
    """Methods of a part's flow in its own file, one that another language's file names, and one that no file defines."""
    key = F.col("p_partkey").cast("string")
    own = F.concat(F.lit("p"), key, F.lit(".py"))
    g = F.when(F.col("p_size") % 2 == 0, own).otherwise(F.concat(F.lit("p"), key, F.lit(".java")))
    each = F.explode(F.array(*[F.struct(n.alias("name"), f.alias("file")) for n, f in ((F.concat(F.lit("f"), F.col("p_size").cast("string")), own), (F.lit("inner"), own), (F.lit("g"), g), (F.lit("nothing"), F.lit(None).cast("string")))]))
    wanted = t.part.select("p_partkey", each.alias("w")).select("p_partkey", "w.name", "w.file")
    known = materialised(definitions.definitions(code_files(t)))
    return definitions.located(wanted, known, ["p_partkey"], "name", "file").select("p_partkey", "name", "path", "start", "end")


@query("TX-6", """select 'p' || p_partkey::varchar || '.py' path, 4 "start", 7 "end", 19 end_char from part union all select 'p' || p_partkey::varchar || '.py', 10, 11, 12 from part union all select 'p' || p_partkey::varchar || '.py', 5, 6, 3 from part
union all select 'p' || p_partkey::varchar || '.java', 1, 3, 3 from part""")
def trimmed_ranges(t: Tables) -> DataFrame:
    """Ranges that go on to the next function's line, over blank lines, and one that is right as it is."""
    files = code_files(t)
    spans = F.when(F.endswith("path", F.lit(".py")), F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("start", "end", "end_char"), r, strict=True)]) for r in ((4, 10, 0), (10, 12, 0), (5, 6, 3))])).otherwise(F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("end"), F.lit(3).alias("end_char"))))
    ranges = files.select("path", F.explode(spans).alias("r")).select("path", "r.*")
    begins = files.select("path", F.explode(F.array(F.lit(4), F.lit(10))).alias("line")).filter(F.endswith("path", F.lit(".py")))
    return definitions.trimmed(ranges, materialised(definitions.lines(files)), begins, [])


@query("TX-5", "select 'p' || p_partkey::varchar || '.py' path, 'inner' \"name\", true local from part union all select 'p' || p_partkey::varchar || '.py', 'g', false from part")
def local_definitions(t: Tables) -> DataFrame:
    """Names that the method of each part's file calls, and whether it defines them itself."""
    files = code_files(t).filter(F.endswith("path", F.lit(".py")))
    calls = files.select("path", F.lit(4).alias("start"), F.lit(7).alias("end"), F.explode(F.array(F.lit("inner"), F.lit("g"))).alias("name"))
    names = materialised(definitions.local_names(files))
    own, others = (definitions.locally_defined(calls, names, how) for how in ("left_semi", "left_anti"))
    return own.select("path", "name", F.lit(True).alias("local")).unionByName(others.select("path", "name", F.lit(False).alias("local")))


# --- paths and positions -----------------------------------------------------------------------------------------------
@query("FN-8", """with p as (select page_id, regexp_extract(url, '://([^/]+)/', 1) host, regexp_extract(url, '\\.[a-z]+/([a-z]+)/', 1) lang, regexp_extract(url, '/([0-9]+)', 1) || '.html' f from pages),
inv as (select distinct lang || '/' || f whole, f from p where page_id % 2 = 0), names as (select f, count(*) n, min(whole) "only" from inv group by 1),
j as (select p.*, page_id % 3 way, coalesce(n, 0) n, "only", lang || '/' || p.f in (select whole from inv) known from p left join names on names.f = p.f)
select page_id, case when way = 2 then 'relative' when way = 0 and known then 'suffix' when n = 1 then 'name' when n > 1 then 'refused' else 'unknown' end how,
case when way = 2 then lang || '/' || f when way = 0 and known then lang || '/' || f when n = 1 then "only" when way = 0 then host || '/' || lang || '/' || f else f end rebased from j""")
def foreign_paths(t: Tables) -> DataFrame:
    """Pages as files of other machines, against an inventory of every second one: by their ends, by name, or relative."""
    host, lang, name = F.regexp_extract("url", "://([^/]+)/", 1), F.regexp_extract("url", r"\.[a-z]+/([a-z]+)/", 1), F.concat(F.regexp_extract("url", "/([0-9]+)", 1), F.lit(".html"))
    told = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/builds/"), host, F.lit("/"), lang, F.lit("/"), name)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("file:///work/"), name)).otherwise(F.concat(F.lit("./"), lang, F.lit("//"), name))
    inventory = t.pages.filter("page_id % 2 = 0").select(F.concat(lang, F.lit("/"), name).alias("whole"))
    return paths.rebased(t.pages.select("page_id", told.alias("told")), inventory, "page_id", "told", "whole")


@query("FN-9", "select p_partkey, 'file:///' || replace(p_name, ' ', '%20') || '/a%2Bb.py' uri, '/' || p_name || '/a+b.py' path from part")
def uri_round_trip(t: Tables) -> DataFrame:
    uri = paths.encoded(F.concat(F.lit("/"), F.col("p_name"), F.lit("/a+b.py")))
    return t.part.select("p_partkey", uri.alias("uri"), paths.decoded(F.substring(uri, 8, 1 << 20)).alias("path"))


@query("FN-10", """with d as (select doc_id, "text", string_split("text", chr(10)) l, (doc_id % 5)::int n, (doc_id % 90)::int c, (doc_id * 13 % 4000)::int o from documents),
e as (select *, string_split(left("text", least(o, length("text"))), chr(10)) h from d)
select doc_id, case when n >= len(l) then length("text") else coalesce(list_sum([length(x) + 1 for x in l[1:n]]), 0) + least(c, length(l[n + 1]) + case when n + 1 < len(l) then 1 else 0 end) end::bigint "offset", (len(h) - 1)::int line, length(h[-1])::int "character" from e""")
def text_positions(t: Tables) -> DataFrame:
    """A position of each document as an offset, and an offset as a position."""
    index = materialised(definitions.indexed(t.documents.select(F.col("doc_id").alias("path"), "text")))
    asked = t.documents.select("doc_id", F.col("doc_id").alias("path"), (F.col("doc_id") % 5).cast("int").alias("line"), (F.col("doc_id") % 90).cast("int").alias("character"), (F.col("doc_id") * 13 % 4000).alias("offset"))
    return definitions.offsets(asked.drop("offset"), index, ["doc_id"]).join(definitions.positions(asked.select("doc_id", "path", "offset"), index, ["doc_id"]), "doc_id")


# --- batches, flows and tools --------------------------------------------------------------------------------------------
BATCHES = """a as (select l_orderkey batch, l_linenumber * 1000000000000 + round(l_extendedprice * 100)::bigint place, l_orderkey::varchar || '-' || (l_partkey % 50)::varchar claim, l_linenumber, case when l_quantity < 5 then 'odd' when l_returnflag = 'A' then 'confirmed' when l_returnflag = 'N' then 'rejected' else 'needs_dataflow' end v from lineitem),
m as (select batch, min(place) place, claim from a where l_linenumber <> 3 group by batch, claim),
v as (select a.batch, a.claim, min_by(v, a.place) v, min(a.place) place from a join m using (batch, claim) group by 1, 2)"""


def line_place() -> Column:
    """A number that orders an order's lines."""
    return F.col("l_linenumber").cast("long") * 1_000_000_000_000 + F.round(F.col("l_extendedprice") * 100).cast("long")


def batch_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    claim = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), (F.col("l_partkey") % 50).cast("string")).alias("claim")
    verdict = F.when(F.col("l_quantity") < 5, "odd").when(F.col("l_returnflag") == "A", " Confirmed").when(F.col("l_returnflag") == "N", "rejected").otherwise("needs_dataflow")
    answers = t.lineitem.select(F.col("l_orderkey").alias("batch"), line_place().alias("place"), claim, verdict.alias("verdict"))
    members = answers.filter("place < 3000000000000 or place >= 4000000000000").groupBy("batch", "claim").agg(F.min("place").alias("place"))
    return answers, members


@query("LG-4 LG-27", f"with {BATCHES} select batch, claim, place, case when v in ('confirmed', 'rejected') then v end verdict, case when v in ('confirmed', 'rejected') then 'semantic' end evidence_kind, case v when 'needs_dataflow' then 'escalated' when 'odd' then 'unreadable' else 'decided' end status from v")
def batch_verdicts(t: Tables) -> DataFrame:
    """Lines answer about the claims of their order; claims that only third lines name aren't in the batch."""
    return batches.verdicts(*batch_tables(t))


@query("LG-27", f"""with {BATCHES}, o as (select claim, 0 kind, batch, place from v where v = 'needs_dataflow' union all select m.claim, 1, m.batch, m.place from m left join v using (batch, claim) where v is null or v not in ('confirmed', 'rejected')),
f as (select claim, min((kind, batch, place)) "at" from o group by 1) select claim, row_number() over (order by "at") - 1 turn from f""")
def batch_reruns(t: Tables) -> DataFrame:
    answers, members = batch_tables(t)
    return batches.again(materialised(batches.verdicts(answers, members)), members)


@query("LG-4", """select o_orderkey run, case when o_orderstatus = 'F' then 'confirmed' when o_orderstatus = 'O' then 'rejected' end verdict, case when q >= 10 then 'dataflow' else 'semantic' end evidence_kind, coalesce(q < 10, o_orderkey % 2 = 0) noted, o_orderstatus in ('F', 'O') readable
from orders left join (select l_orderkey, arg_max(l_quantity, l_linenumber * 1000000000000 + round(l_extendedprice * 100)::bigint) q from lineitem where l_returnflag = 'R' group by 1) on l_orderkey = o_orderkey""")
def single_verdicts(t: Tables) -> DataFrame:
    """Orders as runs; their returned lines are traces, of which the last one counts."""
    answers = t.orders.select(F.col("o_orderkey").alias("run"), F.when(F.col("o_orderstatus") == "F", "CONFIRMED ").when(F.col("o_orderstatus") == "O", "rejected").otherwise("perhaps").alias("verdict"), F.when(F.col("o_orderkey") % 2 == 0, "dataflow").otherwise("semantic").alias("evidence_kind"))
    steps = t.lineitem.select(F.col("l_orderkey").alias("run"), line_place().alias("place"), F.when(F.col("l_returnflag") == "R", "dataflow_verify").otherwise("grep").alias("tool"), F.lit(True).alias("ok"), F.when(F.col("l_quantity") < 10, "engine").alias("error"))
    return batches.single(answers, steps)


@query("GR-6 GX-8")
def merged_flows(t: Tables) -> DataFrame:
    """Orders as findings whose lines are steps of a flow: orders that share a part of a supplier are one finding; every fifth order's flow
    starts at a pattern of calls and stays alone."""
    cust, key = F.col("o_custkey").cast("string"), F.col("o_orderkey")
    source = F.when(key % 5 == 0, F.concat(F.lit("request.get("), cust, F.lit(")"))).otherwise(F.concat(F.lit("handle("), cust, F.lit(")")))
    level = F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical", "odd"))), (F.ceil(F.col("o_totalprice")) % 5 + 1).cast("int"))
    findings = t.orders.select(key.alias("id"), key.alias("at"), F.concat(F.lit("c"), cust).alias("file"), (key % 97).cast("int").alias("line"), level.alias("severity"), (F.col("o_orderstatus") != "P").alias("derived"), source.alias("source"))
    steps = t.lineitem.select(F.col("l_orderkey").alias("id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit(":"), F.col("l_suppkey").cast("string"), F.lit(" node")).alias("step"))
    return merges.by_flow(findings, steps)[0].select("id", "severity", "members", "place.merged")


@query("UD-1 SO-13 TX-7", """with f as (select p_size, 'p' || p_partkey::varchar || '.java' path, row_number() over (partition by p_size order by 'p' || p_partkey::varchar || '.java') n, count(*) over (partition by p_size) total from part)
select p_size call_id, true ok, max(total)::varchar || ' found' summary, '[' || string_agg('{"path":"' || path || '","line":2,"content":"int h' || p_size::varchar || '(int a) {"}', ',' order by path) || ']' as "data", max(total) > 3 truncated from f where n <= 3 group by 1""")
def tool_greps(t: Tables) -> DataFrame:
    """A search for each size's method over the files of all parts, three lines at most, with the exact total."""
    calls = t.part.select(F.col("p_size").alias("call_id")).distinct().withColumn("arguments", F.create_map(F.lit("pattern"), F.concat(F.lit(r"int h"), F.col("call_id").cast("string"), F.lit(r"\(")), F.lit("include"), F.lit("*.java"), F.lit("limit"), F.lit("3")))
    return tools.call("grep", code_files(t), calls)


@query("UD-1 TX-8", """with f as (select left(p_partkey::varchar, 2) head, 'p' || p_partkey::varchar || '.py' path from part where length(p_partkey::varchar) > 1), n as (select *, row_number() over (partition by head order by path) n, count(*) over (partition by head) total from f)
select head::int call_id, true ok, max(total)::varchar || ' found' summary, '[' || string_agg('{"path":"' || path || '"}', ',' order by path) || ']' as "data", max(total) > 5 truncated from n where n <= 5 group by 1""")
def tool_listings(t: Tables) -> DataFrame:
    """Files by a glob of each pair of first digits."""
    head = F.substring(F.col("p_partkey").cast("string"), 1, 2)
    calls = t.part.filter("p_partkey > 9").select(head.cast("int").alias("call_id")).distinct()
    calls = calls.withColumn("arguments", F.create_map(F.lit("pattern"), F.concat(F.lit("**/p"), F.col("call_id").cast("string"), F.lit("*.py")), F.lit("limit"), F.lit("5")))
    return tools.call("list_files", code_files(t), calls)
