"""Queries over event logs, traffic, jobs and dialogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import folds, rows, totals, views
from ..sources import records
from .adapters import Tables
from .registry import query


@query("WN-1 WN-2 WN-6", "select run, max_by(kind, arrival) kind, max(arrival) arrival from v_trail group by run")
def latest_by_arrival(t: Tables) -> DataFrame:
    return folds.latest_by(t.trail(), "run", "arrival", "kind", seq="seq").select("run", "kind", "arrival")


@query("WN-3 GR-13", "select run, max_by(kind, seq) kind, max(seq) seq from v_trail group by run")
def latest_by_seq(t: Tables) -> DataFrame:
    return folds.latest_by(t.trail(), "run", "seq", "kind").select("run", "kind", "seq")


@query("WN-4", """with e as (select *, sum(case kind when 'agent_start' then 1 else 0 end) over (partition by run order by arrival rows unbounded preceding) epoch from v_trail), l as (select run, max(epoch) last from e group by run)
    select e.run, last starts, count(*) filter (where kind = 'agent_step') steps, max(arrival) filter (where kind = 'agent_end') ended from e join l on e.run = l.run and e.epoch = l.last where last > 0 group by 1, 2""")
def agent_rows_fold(t: Tables) -> DataFrame:
    kind = F.col("kind")
    return folds.agent_rows(t.trail(), "run", "arrival", kind == "agent_start", kind == "agent_step", kind == "agent_end", "seq")


@query("WN-5", """with e as (select *, sum(case kind when 'agent_start' then 1 else 0 end) over (partition by run order by seq rows unbounded preceding) epoch from v_trail), m as (select run, max(epoch) last from e group by run)
    select m.run, arg_max(e.cents, e.seq) filter (where e.event_type = 'view') verdict, arg_max(e.k, e.seq) filter (where e.event_type = 'click') path from m left join e on e.run = m.run and e.epoch = m.last group by 1""")
def candidate_fold_invalidation(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return folds.candidate_rows(t.trail(), "run", "seq", F.col("kind") == "agent_start", {"verdict": ("cents", kind == "view"), "path": ("k", kind == "click")})


@query("WN-8", "select o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) latest, bool_or(o_orderstatus in ('P', 'O')) in_flight from orders group by 1")
def latest_audit(t: Tables) -> DataFrame:
    return folds.latest_bundle(t.orders, "o_custkey", "o_orderdate", "o_orderkey", views.active(F.col("o_orderstatus"), ("P", "O")))


@query("WN-9 AG-19", """with c as (select run, min(k) least, count(*) n, count(*) filter (where event_type = 'error') failures, sum(cents)::bigint cents from v_trail group by run)
    select sum(n)::bigint attempts, sum(failures)::bigint failures, count(*) callers, greatest(0, sum(n) - sum(least))::bigint retried, sum(cents)::bigint cents from c""")
def model_call_totals(t: Tables) -> DataFrame:
    return totals.model_call_totals(t.trail(), "run", "k", F.col("event_type") == "error", "cents")


@query("WN-10", "select run, seq from (select run, seq, row_number() over (partition by run order by arrival) n from v_trail where kind = 'agent_step') where n <= 5")
def topk_new_per_scope(t: Tables) -> DataFrame:
    return rows.top_per(t.trail().filter("kind = 'agent_step'"), ["run"], 5, F.col("arrival").asc_nulls_last(), F.col("seq").asc_nulls_last()).select("run", "seq")


@query("WN-12 SRC-8", "select seq, run, kind, (select count(*) from v_trail) total from v_trail order by seq desc limit 500")
def ring_page(t: Tables) -> DataFrame:
    return rows.page(t.trail().select("seq", "run", "kind"), 0, 500, F.desc("seq"))


@query("WN-13", "select kind, min(seq) first_seq, count(distinct run) runs from v_trail group by kind")
def kinds_seen(t: Tables) -> DataFrame:
    return folds.seen_kinds(t.trail(), "kind", "seq", "run")


@query("WN-14 LG-2", """with b as (select distinct run, k from v_trail where seq < 500), a as (select distinct run, k from v_trail)
    select a.run, count(*) places, count(*) filter (where not exists (select 1 from b where b.run = a.run and b.k is not distinct from a.k)) fresh from a group by a.run""")
def new_places_per_round(t: Tables) -> DataFrame:
    return folds.fresh_places(t.trail().filter("seq < 500"), t.trail(), "run", "k")


@query("AG-18", "select event_type path, count(*) n, round(avg(round(\"value\" * 100)::bigint), 4) mean_cents, count(*) filter (where event_type = 'error') errors, min(event_id) first_seen from events group by 1 order by n desc, first_seen limit 3")
def traffic_by_path(t: Tables) -> DataFrame:
    e = t.events.select(F.col("event_type").alias("path"), F.round(F.col("value") * 100).cast("long").alias("cents"), "event_id")
    return totals.traffic_by_endpoint(e, "path", "cents", F.col("path") == "error", "event_id", 3)


@query("AG-16 AG-17", """select event_type, sum(k)::bigint prompt, sum(case when k % 3 = 0 then k end)::bigint cached, round(sum(case when k % 3 = 0 then k end) / nullif(sum(k), 0)::double, 6) cache_share, count(k) reported from v_trail group by 1""")
def ai_totals(t: Tables) -> DataFrame:
    return totals.ai_totals(t.trail().withColumn("cached_k", F.when(F.col("k") % 3 == 0, F.col("k"))), ["event_type"], "k", "cached_k")


@query("AG-20 AG-21", """select kind, count(o_orderkey) filter (where o_orderstatus = 'O') queued, count(o_orderkey) filter (where o_orderstatus = 'P') running, count(o_orderkey) filter (where o_orderstatus = 'F') finished
    from (values ('1-URGENT'), ('2-HIGH'), ('9-NONE')) a(kind) left join orders on o_orderpriority = kind group by kind""")
def queue_by_kind_axis(t: Tables) -> DataFrame:
    return totals.on_axis(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH", "9-NONE"], {n: F.col("o_orderstatus") == s for s, n in (("O", "queued"), ("P", "running"), ("F", "finished"))})


@query("AG-22", "select count(*) filter (where o_orderstatus = 'O') queued, count(*) filter (where o_orderstatus = 'P') pending, count(*) filter (where o_orderstatus = 'O') > count(*) filter (where o_orderstatus = 'P') degraded from orders")
def queue_health(t: Tables) -> DataFrame:
    return totals.queue_health(t.orders, F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "P")


@query("AG-23", "select count(*) events, count(distinct run) runs, count(*) filter (where kind = 'agent_start') starts, count(*) filter (where kind = 'agent_end') ends, max(seq) last_seq from v_trail")
def trail_counters(t: Tables) -> DataFrame:
    return totals.trail_counters(t.trail(), {"starts": F.col("kind") == "agent_start", "ends": F.col("kind") == "agent_end"})


@query("AG-26", "select run, event_type, count(*) n from v_trail group by all")
def tool_histogram(t: Tables) -> DataFrame:
    return totals.histogram(t.trail(), "run", "event_type")


@query("AG-27", """select run, min(seq) breach_seq, arg_min(cap, (seq, cap)) cap from (select run, seq, case when count(*) over w > 20 then 'calls' when sum(coalesce(k, 0)) over w > 500 then 'tokens' end cap from v_trail window w as (partition by run order by seq rows unbounded preceding)) where cap is not null group by run""")
def budget_first_breach(t: Tables) -> DataFrame:
    return totals.first_breach(t.trail(), "run", "seq", [("calls", F.lit(1), 20), ("tokens", F.col("k"), 500)])


@query("PRJ-8 PRJ-9", """select conv_id, turn, case when text like 'context budget exceeded:%' then 'context_budget' when text like 'model call failed:%' then 'model' when turn % 2 = 0 then 'tool_arguments' else 'tool_execution' end failure_kind,
    (select count(*) from conversations where role = 'assistant') total from conversations where role = 'assistant' and turn % 3 = 0 and lower('assistant s  ' || text || '  ' || case when turn % 2 = 0 then 'missing path' else 'it broke' end || ' {}') like '%th%'""")
def dialogue_filter(t: Tables) -> DataFrame:
    c = t.conversations
    events = c.select(F.concat_ws("-", "conv_id", "turn").alias("seq"), "conv_id", "turn", F.when(F.col("role") == "assistant", "agent_step").otherwise("other").alias("kind"), F.col("role").alias("agent"), F.lit("s").alias("scope"), F.col("text").alias("thought"), F.lit(None).cast("string").alias("tool"), F.lit("{}").alias("arguments"), (F.col("turn") % 3 != 0).alias("ok"), F.lit("").alias("summary"), F.when(F.col("turn") % 3 == 0, F.when(F.col("turn") % 2 == 0, "missing path").otherwise("it broke")).alias("error"))
    return views.dialogue_filter(views.dialogue(events), agent="assistant", needle="TH", problems=True).select("conv_id", "turn", "failure_kind", "total")


@query("PRJ-10", "select seq, coalesce(k, -1) k, coalesce(event_type, 'unknown') label from v_trail where kind = 'agent_end'")
def finding_rows(t: Tables) -> DataFrame:
    return views.finding_rows(t.trail().select("seq", "k", F.col("event_type").alias("label"), "kind"), "agent_end", {"k": -1, "label": "unknown"}).drop("kind")


@query("PRJ-14", "select seq from v_trail where run in (select run from v_trail where event_type = 'signup' and k > 50) or (kind = 'agent_end' and k < 10)")
def task_evidence(t: Tables) -> DataFrame:
    e = t.trail()
    return views.task_evidence(e, e.filter("event_type = 'signup' and k > 50"), "run", (F.col("kind") == "agent_end") & (F.col("k") < 10)).select("seq")


@query("PRJ-7", "select o_orderkey, o_orderstatus state, o_totalprice > 100000 large, coalesce(nullif(o_orderpriority, ''), 'none') priority from orders")
def job_summary(t: Tables) -> DataFrame:
    return views.summarised(t.orders, {"o_orderkey": "o_orderkey", "state": "o_orderstatus"}, {"large": F.col("o_totalprice") > 100000}, {"priority": ("o_orderpriority", "none")})


@query("PRJ-17", "select o_orderkey, o_orderstatus in ('O', 'P') active, o_orderstatus = 'F' terminal from orders")
def job_predicates(t: Tables) -> DataFrame:
    return views.job_rows(t.orders, "o_orderstatus", ("O", "P"), ("F",)).select("o_orderkey", "active", "terminal")


@query("SM-3 SM-2 FN-28", """with l as (select run, max(seq) seq, count(*) filter (where kind = 'agent_start') attempts, max_by(kind, seq) state, max(ts) beat from v_trail group by run), n as (select max(ts) now from v_trail)
    select run, case when state = 'agent_end' then 'skipped' when date_diff('second', beat, now) < 3600 * 24 then 'recovered' when attempts < 20 then 'requeued' else 'failed' end decision from l, n""")
def stale_adjudication(t: Tables) -> DataFrame:
    e = t.trail()
    last = e.groupBy("run").agg(F.count_if(F.col("kind") == "agent_start").alias("attempts"), F.max_by("kind", "seq").alias("state"), F.max("ts").alias("beat"))
    both = last.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))  # one row
    return both.select("run", folds.stale(both, F.col("now"), F.col("state") == "agent_end", 86400, 20).alias("decision"))


@query("SM-4", "select o_orderkey from orders where o_orderstatus = 'O' and o_custkey not in (select c_custkey from customer where c_acctbal > 0)")
def startup_reconcile(t: Tables) -> DataFrame:
    return folds.orphans(t.orders.filter("o_orderstatus = 'O'"), t.customer.filter("c_acctbal > 0"), "o_custkey", "c_custkey").select("o_orderkey")


@query("SM-7", """select run, max(seq) revision, max_by(kind, seq) state, count(*) writes from v_trail where seq <= coalesce((select min(seq) from v_trail e where e.run = v_trail.run and e.kind = 'agent_end'), 1e18) group by run""")
def job_state_fold(t: Tables) -> DataFrame:
    """Events up to the first terminal one count; later ones are absorbed."""
    return folds.state_fold(t.trail(), "run", "seq", "kind", F.col("kind") == "agent_end")


@query("GR-7", "select o_custkey fingerprint, min(o_orderkey) job from orders group by 1")
def idempotent_create(t: Tables) -> DataFrame:
    return folds.created_once(t.orders.withColumnRenamed("o_custkey", "fingerprint"), "fingerprint", "o_orderkey")


@query("SM-12 LG-29", """with c as (select user_id scope, count(*) n, count(*) filter (where event_type = 'error') errors, count(distinct event_type) kinds from events group by 1)
    select scope, case when errors > 40 then 'gaps' when kinds < 4 then 'not_covered' when n > 90 then 'new_places' when errors > 20 then 'unread' when n < 40 then 'undecided' else 'sufficient' end decision from c""")
def closure_rule(t: Tables) -> DataFrame:
    c = t.events.groupBy(F.col("user_id").alias("scope")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_distinct("event_type").alias("kinds"))
    facts = c.select("scope", F.greatest(F.col("errors") - 40, F.lit(0)).alias("gaps"), (F.col("kinds") >= 4).alias("covered"), F.col("n").alias("new_places"), F.greatest(F.col("errors") - 20, F.lit(0)).alias("unread"), F.greatest(40 - F.col("n"), F.lit(0)).alias("undecided"))
    return folds.closure(facts, "scope", folds.closure_rules(91))


@query("SRC-9 SM-14", "select seq, kind, (select count(*) from v_trail where seq > 200) > 100 more from v_trail where seq > 200 order by seq limit 100")
def trail_page_after(t: Tables) -> DataFrame:
    rest = t.trail().filter("seq > 200")
    return rows.page(rest.select("seq", "kind"), 0, 100, F.col("seq")).select("seq", "kind", (F.col("total") > 100).alias("more"))


@query("SRC-10", """with s as (select *, turn // 2 % 2 as session_no from conversations), n as (select *, case when session_no is distinct from lag(session_no) over (partition by conv_id order by turn) then 1 else 0 end fresh from s),
    g as (select *, sum(fresh) over (partition by conv_id order by turn rows unbounded preceding) no from n) select conv_id, turn, role from (select *, max(no) over (partition by conv_id) last from g) where no = last""")
def last_session_rows(t: Tables) -> DataFrame:
    told = t.conversations.withColumn("session", F.floor(F.col("turn") / 2) % 2)
    return records.last_session(told, "conv_id", "session", "turn").select("conv_id", "turn", "role")


@query("LG-14", "select run, max(k) max_steps, sum(k)::bigint sum_steps, case when max_by(kind, seq) = 'agent_end' then 'blocked' when count(*) filter (where kind = 'agent_start') > 10 then 'canceled' else 'planned' end state from v_trail group by run")
def work_closing(t: Tables) -> DataFrame:
    state = F.when(F.max_by("kind", "seq") == "agent_end", "blocked").when(F.count_if(F.col("kind") == "agent_start") > 10, "canceled").otherwise("planned")
    return folds.work_closed(t.trail(), "run", "seq", "k", state)


@query("LG-16", "select run, max_by(seq, seq) filter (where event_type = 'view') last_view, string_agg(distinct event_type, ',' order by event_type) reasons from v_trail group by run")
def last_evidence(t: Tables) -> DataFrame:
    return folds.last_matching(t.trail(), "run", "seq", F.col("event_type") == "view", "event_type").withColumnRenamed("last", "last_view")


@query("LG-18", "select conv_id, max(turn) turns from conversations group by conv_id having max_by(role, turn) <> 'assistant'")
def early_stopped_runs(t: Tables) -> DataFrame:
    return folds.stopped_early(t.conversations, "conv_id", "turn", "role", "assistant")


@query("LG-31", "select run, max(seq) last_summary, max_by(cents, seq) cents from v_trail where event_type in ('view', 'signup') group by run")
def progress_mirror(t: Tables) -> DataFrame:
    return folds.progress(t.trail(), "run", "seq", "event_type", ["view", "signup"], "cents").select("run", F.col("seq").alias("last_summary"), "cents")


@query("LG-13", "select run, max_by(kind, seq) state, count(*) beats, count(*) filter (where kind = 'agent_end') = 0 keeps from v_trail group by run")
def coverage_upkeep(t: Tables) -> DataFrame:
    return folds.coverage_upkeep(t.trail(), "run", "seq", "kind", F.col("kind") == "agent_end")


@query("FN-18", """select event_id, case when "value"::decimal(18,6) * 1000 < 1000 then round("value"::decimal(18,6) * 1000)::bigint::varchar || ' ms' when "value"::decimal(18,6) * 1000 < 60000 then round("value"::decimal(18,6), 1)::decimal(18,1)::varchar || ' s' else (round("value"::decimal(18,6) * 1000)::bigint // 60000)::varchar || ' m ' || (round("value"::decimal(18,6) * 1000)::bigint % 60000 // 1000)::varchar || ' s' end label from events""")
def duration_labels(t: Tables) -> DataFrame:
    return t.events.select("event_id", scalars.duration_label(F.col("value").cast("decimal(18,6)") * 1000).alias("label"))


@query("SM-1", """with q as (select event_id, row_number() over (order by event_id desc) back from events), o as (select event_id, row_number() over (order by event_id) n from q where back <= 5000 and event_id % 3 <> 0)
    select event_id entry_id, ((n - 1) // 10)::int consumer from o where n <= 40""")
def queue_claims(t: Tables) -> DataFrame:
    """Ten entries for each of four consumers, of the newest 5,000; a third is acknowledged."""
    entries = t.events.select(F.col("event_id").alias("entry_id"))
    return folds.claimed(entries, entries.filter("entry_id % 3 = 0"), 4, 10, 5000).select("entry_id", "consumer")


@query("SM-5", """with j as (select o_orderkey job_id, case o_orderstatus when 'F' then 'succeeded' when 'O' then 'queued' else 'running' end state, o_orderkey % 4 revision from orders)
    select job_id, case when ok then 'running' else state end state, case when ok then revision + 1 else revision end revision, ok applied from (select *, state = 'queued' and revision = 1 and job_id % 2 = 0 ok from j)""")
def compare_and_set(t: Tables) -> DataFrame:
    """Writes to every second job that expect it queued at revision 1."""
    state = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "queued").otherwise("running")
    jobs = t.orders.select(F.col("o_orderkey").alias("job_id"), state.alias("state"), (F.col("o_orderkey") % 4).alias("revision"))
    writes = jobs.filter("job_id % 2 = 0").select("job_id", F.lit("queued").alias("expected_state"), F.lit(1).cast("long").alias("expected_revision"), F.lit("running").alias("state"), F.lit(True).alias("bump"))
    return folds.compared_and_set(jobs, writes)


@query("SM-6", """with e as (select c_custkey fingerprint, case c_custkey % 3 when 0 then 'failed' when 1 then 'succeeded' else 'running' end state from customer where c_custkey % 2 = 0),
    s as (select o_custkey fingerprint, o_orderkey job_id, o_orderkey % 5 = 0 force, row_number() over (partition by o_custkey order by o_orderkey) n from orders)
    select s.fingerprint, job_id, case when n > 1 then 'duplicate' when state is null then 'created' when state = 'failed' or force and state = 'succeeded' then 'redriven' else 'duplicate' end outcome from s left join e on e.fingerprint = s.fingerprint""")
def submissions(t: Tables) -> DataFrame:
    """Orders as submissions by customer, every second of whom has a job already."""
    state = F.when(F.col("c_custkey") % 3 == 0, "failed").when(F.col("c_custkey") % 3 == 1, "succeeded").otherwise("running")
    existing = t.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("fingerprint"), state.alias("state"))
    return folds.submitted(existing, t.orders.select(F.col("o_custkey").alias("fingerprint"), F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") % 5 == 0).alias("force")))


@query("SM-8 SM-9", """with l as (select user_id, max(ts) beat from events group by 1), n as (select max(ts) now from events), j as (select c_custkey job_id, case c_custkey % 3 when 0 then 'succeeded' else 'running' end state, timestamp '2024-01-01 00:00:00' beat from customer)
    select job_id, state, case when state = 'succeeded' then j.beat else greatest(j.beat, l.beat) end beat from j left join l on l.user_id = job_id, n where state <> 'succeeded' or date_diff('second', j.beat, now) < 86400""")
def heartbeats(t: Tables) -> DataFrame:
    """Jobs of customers with beats of users, after a day's time to live."""
    begun = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    jobs = t.customer.select(F.col("c_custkey").alias("job_id"), F.when(F.col("c_custkey") % 3 == 0, "succeeded").otherwise("running").alias("state"), begun.alias("beat"))
    beaten = folds.beaten(jobs, t.events.select(F.col("user_id").alias("job_id"), F.col("ts").alias("at")))
    both = beaten.crossJoin(F.broadcast(t.events.agg(F.max("ts").alias("now"))))  # one row
    return folds.expired(both, F.col("now"), 86400).select("job_id", "state", "beat")


@query("WN-7", "select o_custkey, max_by(o_orderkey, (strftime(o_orderdate, '%Y-%m-%d'), o_orderkey)) latest from orders group by 1")
def latest_bundle(t: Tables) -> DataFrame:
    return folds.latest_bundle(t.orders.withColumn("created", F.date_format("o_orderdate", "yyyy-MM-dd")), "o_custkey", "created", "o_orderkey")
