"""Queries over keyed ledgers: upserts, merges, caps and the deterministic dry run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import dryrun, folds, joins, ledger, rows, views
from .adapters import Tables
from .registry import query


@query("LG-3", "select l_orderkey, l_partkey, min(l_linenumber) first_line, substr(sha256(l_orderkey::varchar || chr(0) || l_partkey::varchar || chr(0)), 1, 20) id from lineitem where l_quantity > 5 group by 1, 2")
def candidate_parser(t: Tables) -> DataFrame:
    return ledger.parsed_candidates(t.lineitem, ["l_orderkey", "l_partkey"], "l_linenumber", F.col("l_quantity") > 5, "first_line").select("l_orderkey", "l_partkey", "first_line", "id")


@query("LG-4", "select l_orderkey, l_linenumber, l_returnflag verdict from (select l_orderkey, l_linenumber, l_returnflag, l_quantity, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice) n from lineitem) where n = 1 and l_returnflag in ('A', 'R')")
def verdict_batch(t: Tables) -> DataFrame:
    """A repeated id keeps its first row, even if that row is then dropped."""
    first = rows.first_by(t.lineitem, ["l_orderkey", "l_linenumber"], F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice"))
    return first.filter(F.col("l_returnflag").isin("A", "R")).select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("verdict"))


@query("LG-5", "select p.p_partkey, l.n answered, l.n is null absent from part p left join (select l_partkey, count(*) n from lineitem group by 1) l on l.l_partkey = p.p_partkey")
def attack_path_answers(t: Tables) -> DataFrame:
    return ledger.answered(t.part.select("p_partkey"), t.lineitem.withColumnRenamed("l_partkey", "p_partkey"), "p_partkey")


@query("LG-7", "select o_custkey, count(*) leads, bool_and(o_totalprice > 20000) commits, case when bool_and(o_totalprice > 20000) then count(*) else 0 end written from orders group by 1")
def lead_plan_commit(t: Tables) -> DataFrame:
    """One invalid decision rejects its whole batch."""
    return ledger.batch_commit(t.orders, "o_custkey", F.col("o_totalprice") > 20000)


@query("LG-8 LG-9", "select substr(sha256(l_suppkey::varchar || '|' || l_returnflag), 1, 20) gap, max(case l_linestatus when 'F' then 1 else 0 end) resolved, string_agg(distinct l_linenumber::varchar, ',' order by l_linenumber::varchar) refs from lineitem group by l_suppkey, l_returnflag")
def gap_upsert(t: Tables) -> DataFrame:
    return ledger.upserted_gaps(t.lineitem, ["l_suppkey", "l_returnflag"], F.col("l_linestatus") == "F", "l_linenumber").select("gap", "resolved", "refs")


@query("LG-10", "select l_suppkey, l_returnflag, string_agg(distinct l_partkey::varchar, ',' order by l_partkey::varchar) files, count(*) >= 30 blocked from lineitem group by 1, 2")
def claim_work(t: Tables) -> DataFrame:
    return ledger.claim_work(t.lineitem, ["l_suppkey", "l_returnflag"], "l_partkey", 30)


@query("LG-11 UD-3", "select l_orderkey, l_linenumber, l_returnflag from lineitem where l_returnflag in ('A', 'R') and l_partkey in (select p_partkey from part where p_size > 10)")
def record_dispatch(t: Tables) -> DataFrame:
    return ledger.recorded(t.lineitem, t.part.filter("p_size > 10"), "l_partkey", "p_partkey", F.col("l_returnflag").isin("A", "R")).select("l_orderkey", "l_linenumber", "l_returnflag")


@query("AG-24", "select l_orderkey, least(count(*), 3) shown, greatest(count(*) - 3, 0) omitted from lineitem group by 1")
def board_sections(t: Tables) -> DataFrame:
    return ledger.sections(t.lineitem, "l_orderkey", "l_linenumber", 3)


@query("LG-25", "select p_brand, bool_or(p_type like 'STANDARD%') gate, count(*) filter (where p_type like 'STANDARD%') kept from part group by 1")
def capability_gate(t: Tables) -> DataFrame:
    return folds.capability_gate(t.part, "p_brand", F.col("p_type").startswith("STANDARD"))


@query("GR-8", "select c_nationkey, max_by(c_mktsegment, c_custkey) last_segment, min_by(c_name, c_custkey) first_name from customer group by 1")
def context_merge(t: Tables) -> DataFrame:
    return folds.context_merge(t.customer, "c_nationkey", "c_custkey", {"last_segment": "c_mktsegment"}, {"first_name": "c_name"})


@query("GR-9", "select p_brand, max_by(p_type, (p_size, -p_partkey)) kind, min_by(p_name, (case when p_name = '' then 1 else 0 end, p_partkey)) name, count(distinct p_type) sites from part group by 1")
def architecture_merge(t: Tables) -> DataFrame:
    return folds.architecture_merge(t.part, "p_brand", F.struct("p_size", -F.col("p_partkey")), "p_type", "p_name", "p_partkey")


@query("GR-10 GR-7", "select s_suppkey k, s_name who from supplier union all select min(p_partkey), trim(p_name) from part where trim(p_name) <> '' and trim(p_name) not in (select s_name from supplier) group by trim(p_name)")
def threat_merge(t: Tables) -> DataFrame:
    """Names of suppliers, and those of parts that aren't among them, each once."""
    old, new = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("who")), t.part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("who"))
    return rows.insert_absent(old, new, "who", F.col("k"))


@query("SNK-5", "select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) n from orders where o_orderstatus = 'F') where n = 1")
def newest_complete_body(t: Tables) -> DataFrame:
    return rows.first_by(t.orders.filter("o_orderstatus = 'F'"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@query("SO-5", "select c_nationkey, max(c_custkey) last_activity, count(*) n from customer group by 1 order by last_activity desc, c_nationkey")
def recent_activity(t: Tables) -> DataFrame:
    return joins.recent_activity(t.customer, "c_nationkey", "c_custkey")


@query("SO-11")
def claim_batching(t: Tables) -> DataFrame:
    """First-fit packing of orders by shared parts, a supplier's orders at a time."""
    from ..operators import packing

    return packing.first_fit(t.lineitem.select(F.col("l_suppkey").alias("scope"), F.col("l_orderkey").alias("claim"), F.col("l_partkey").alias("file")), 4, 8)


SIGNALS = [("hardcoded_secret", r"token = \"[0-9a-f]{8}"), ("sensitive_data_exposure", r"@mail[0-9]"), ("injection", r"password=")]


@query("LG-1 LG-2", """with l as (select source scope, doc_id::varchar file, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) no from documents),
    h as (select scope, file, no, case when regexp_matches(line, 'token = \"[0-9a-f]{8}') then 'hardcoded_secret' when regexp_matches(line, '@mail[0-9]') then 'sensitive_data_exposure' when regexp_matches(line, 'password=') then 'injection' end kind from l),
    f as (select *, row_number() over (partition by scope, file, kind order by no) n from h where kind is not null), c as (select scope, file, no, kind, row_number() over (partition by scope order by file, no, kind) k from f where n = 1),
    s as (select distinct source scope from documents) select s.scope, count(c.file)::bigint candidates, count(c.file)::bigint rejected, count(distinct c.file || ':' || c.no::varchar)::bigint places, case when count(c.file) > 0 then 2 else 1 end::int rounds, 'sufficient' state, 0::bigint findings
    from s left join c on c.scope is not distinct from s.scope and c.k <= 50 group by s.scope""")
def dry_run(t: Tables) -> DataFrame:
    """Survey, signals and candidates without a model: every candidate is rejected."""
    files = t.documents.select(F.col("source").alias("scope"), F.col("doc_id").cast("string").alias("file"), "text")
    return dryrun.run(files, SIGNALS, per_scope=50, max_rounds=3)


@query("LG-23", "select p_partkey, p_partkey in (select l_partkey from lineitem) available from part")
def artifact_availability(t: Tables) -> DataFrame:
    return joins.availability(t.part.select("p_partkey"), t.lineitem.select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("PRJ-6", "select o_orderkey, array_to_string([o_orderstatus, o_orderpriority], ' ') command from orders")
def scan_summary(t: Tables) -> DataFrame:
    return views.scan_summaries(t.orders.select("o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("command"))).select("o_orderkey", F.col("command_line").alias("command"))
