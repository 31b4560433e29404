"""Folds of logs: the latest state of each key, merges of versions, coverage and queue decisions. Latest-wins folds are max_by
aggregates that combine before the shuffle; windows are used only where a running state within a key is the semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rows


# --- latest wins ----------------------------------------------------------------------------------------------------
def latest_by(events: DataFrame, key: str, order: str, *columns: str, seq: str | None = None) -> DataFrame:
    """Each key with columns of its last row by `order`, and the order itself. Of rows of one order the first by `seq` counts; without a
    `seq` orders must differ, or any of them does."""
    last = F.struct(F.col(order), -F.col(seq)) if seq else F.col(order)
    last = F.when(F.col(order).isNotNull(), last) if seq else last
    return events.groupBy(key).agg(*[F.max_by(c, last).alias(c) for c in columns], F.max(order).alias(order))


def latest_on_axis(events: DataFrame, key: str, arrival: str, axis: list[str], *columns: str) -> DataFrame:
    """`latest_by` arrival with a row for each key of the axis, in that order, and then the others as they were first seen (place)."""
    each = events.groupBy(key).agg(*[F.max_by(c, arrival).alias(c) for c in columns], F.min(arrival).alias("__seen"))
    known = F.array_position(F.array(*map(F.lit, axis)), F.col(key))
    missing = events.sparkSession.createDataFrame([(a,) for a in axis], f"{key} string").join(each, key, "left_anti")
    every = each.unionByName(missing, allowMissingColumns=True)
    return every.withColumn("place", F.when(known > 0, known - 1).otherwise(F.col("__seen") + len(axis))).drop("__seen")


def latest_counters(events: DataFrame, key: str, order: str, counters: str) -> DataFrame:
    """The last counters (a map) of each key that aren't empty."""
    return events.filter(F.size(counters) > 0).groupBy(key).agg(F.max_by(counters, order).alias(counters))


def latest_bundle(bundles: DataFrame, key: str, created: str, name: str, *running: Column) -> DataFrame:
    """Each key's bundle or audit with the greatest (created, name), and whether any is in flight."""
    return bundles.groupBy(key).agg(F.max_by(name, F.struct(created, name)).alias("latest"), *[F.bool_or(r).alias("in_flight") for r in running])


def since_last(events: DataFrame, key: str, order: str, starts: Column, seq: str | None = None) -> DataFrame:
    """Events from the last start of their key on (all where it has none), with starts: how many it has. The last start is an aggregate, so no
    running number goes over a key's events. Events of one order follow each other by `seq`, those without one come last."""
    from . import skew
    from .store import materialised

    rows_ = materialised(events)
    at = F.struct(F.col(order).isNull().alias("__none"), order, *([seq] if seq else []))
    last = rows_.groupBy(key).agg(F.max(F.when(starts, at)).alias("__last"), F.count_if(starts).alias("starts"))
    return skew.keyed_join(rows_, last, [key], "inner", (order,)).filter(F.col("__last").isNull() | (at >= F.col("__last"))).drop("__last")


def agent_rows(events: DataFrame, run: str, order: str, starts: Column, steps: Column, ends: Column, seq: str | None = None) -> DataFrame:
    """Each run's row: starts, the steps since the last start, and where it ended (null: it goes on). Runs that never started have none.
    Events of one order follow each other by `seq`."""
    now = since_last(events, run, order, starts, seq).filter("starts > 0")
    return now.groupBy(run, "starts").agg(F.count_if(steps).alias("steps"), F.max(F.when(ends, F.col(order))).alias("ended"))


def candidate_rows(events: DataFrame, key: str, order: str, starts: Column, columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Each candidate's columns (name: value and when it is told): the last ones since the last event that takes all back."""
    now = since_last(events, key, order, starts)
    return now.groupBy(key).agg(*[F.max_by(value, F.when(told, F.col(order))).alias(name) for name, (value, told) in columns.items()])


def seen_kinds(events: DataFrame, kind: str, order: str, run: str) -> DataFrame:
    """Kinds with where each is first seen and the runs that have it."""
    return events.groupBy(kind).agg(F.min(order).alias(f"first_{order}"), F.count_distinct(run).alias("runs"))


def fresh_places(before: DataFrame, after: DataFrame, scope: str, place: str) -> DataFrame:
    """Places of each scope after a round, and those that weren't there before (null is a place)."""
    old = before.select(F.col(scope).alias("__scope"), F.col(place).alias("__place"), F.lit(True).alias("__known")).distinct()
    now = after.select(scope, place).distinct()
    told = now.join(old, (F.col(scope) == F.col("__scope")) & F.col(place).eqNullSafe(F.col("__place")), "left")
    return told.groupBy(scope).agg(F.count("*").alias("places"), F.count_if(F.col("__known").isNull()).alias("fresh"))


def next_round(scopes: DataFrame, state: str, failures: str, most_failures: int, yield_share: Column, least_yield: float, round_no: int, max_rounds: int) -> DataFrame:
    """Scopes that another round takes: insufficient ones that haven't failed too often, unless the round before brought too little or
    was the last."""
    if round_no >= max_rounds + 1:
        return scopes.limit(0)
    return scopes.filter((F.col(state) == "insufficient") & (F.col(failures) <= most_failures) & (yield_share >= least_yield))


# --- dedupe and merges ----------------------------------------------------------------------------------------------
def body_owners(bodies: DataFrame, key: str, text: str, length: int = 20) -> DataFrame:
    """key, content (hash of the body) and owner: the first key with this content."""
    d = bodies.select(key, F.sha1(text).alias("__h"))
    owner = d.groupBy("__h").agg(F.min(key).alias("owner"))
    return d.join(owner, "__h").select(key, F.substring("__h", 1, length).alias("content"), "owner")


def claim_groups(candidates: DataFrame, claim: list[str], key: str, weight: str, *then: str) -> DataFrame:
    """Groups of candidates that claim the same: members, weight, and as representative the key of the heaviest one, by `then` and the key
    among equals."""
    return candidates.groupBy(*claim).agg(F.count("*").alias("members"), F.max_by(key, F.struct(weight, *then, key)).alias("representative"), F.max(weight).alias(weight))


def fanned_out(members: DataFrame, claim: list[str], key: str, weight: Column, verdict: Column) -> DataFrame:
    """Each member with its group's representative and its verdict; inherited where the representative is another. Nulls in a claim
    are equal. `weight` holds the key, so one struct a claim moves."""
    reps = members.groupBy(*claim).agg(F.max(weight).alias("__w")).withColumn("rep", F.col("__w")[key])
    same = F.lit(True)
    for c in claim:
        same = same & F.col(f"m.{c}").eqNullSafe(F.col(f"r.{c}"))
    return members.alias("m").join(reps.alias("r"), same).select(F.col(f"m.{key}"), "rep", verdict.alias("verdict"), (F.col(f"m.{key}") != F.col("rep")).alias("inherited"))


def context_merge(versions: DataFrame, key: str, order: str, last: dict[str, str], first: dict[str, str]) -> DataFrame:
    """Versions of a context as one: some columns of the last version, others of the first."""
    return versions.groupBy(key).agg(*[F.max_by(c, order).alias(n) for n, c in last.items()], *[F.min_by(c, order).alias(n) for n, c in first.items()])


def architecture_merge(components: DataFrame, area: str, rank: Column, kind: str, name: str, order: str) -> DataFrame:
    """Components of an area: the kind of the best rank, the first name that isn't empty and the number of sites."""
    filled = F.struct(F.when(F.coalesce(name, F.lit("")) == "", 1).otherwise(0), F.col(order))
    return components.groupBy(area).agg(F.max_by(kind, rank).alias("kind"), F.min_by(name, filled).alias("name"), F.count_distinct(kind).alias("sites"))


# --- coverage ---------------------------------------------------------------------------------------------------------
def coverage_from_reads(reads: DataFrame, file: str, lo: str, hi: str, total: str, ok: Column | None = None) -> DataFrame:
    """Reads of each file that went well: their number, the greatest total, and where they begin and end."""
    good = reads if ok is None else reads.filter(ok)
    return good.groupBy(file).agg(F.count("*").alias("reads"), F.max(total).alias("total"), F.min(lo).alias("first_lo"), F.max(hi).alias("last_hi"))


def compaction(reads: DataFrame, file: str, reused: Column, lo: str, total: str) -> DataFrame:
    """Windows of each file, apart for reused reads: their number, the greatest total and their begins."""
    return reads.groupBy(file, reused.alias("reused")).agg(F.count("*").alias("windows"), F.max(total).alias("total"), F.array_join(F.array_sort(F.collect_set(F.col(lo).cast("string"))), ",").alias("starts"))


def complete_reads(reads: DataFrame, file: str, complete: Column, step: str, *order: str) -> DataFrame:
    """The first and the last complete read of each file."""
    at = F.struct(*order)
    return reads.filter(complete).groupBy(file).agg(F.max_by(step, at).alias(f"last_{step}"), F.min_by(step, at).alias(f"first_{step}"))


def closure(scopes: DataFrame, scope: str, rules: list[tuple[str, Column]], otherwise: str = "sufficient") -> DataFrame:
    """The first rule in order that holds decides about a scope."""
    decision = F.when(F.lit(False), "")
    for name, rule in rules:
        decision = decision.when(rule, name)
    return scopes.select(scope, decision.otherwise(otherwise).alias("decision"))


def closure_rules(least_new: int) -> list[tuple[str, Column]]:
    """The six decisions about a scope with columns gaps, covered, new_places, unread and undecided, in order."""
    return [("gaps", F.col("gaps") > 0), ("not_covered", ~F.col("covered")), ("new_places", F.col("new_places") >= least_new), ("unread", F.col("unread") > 0), ("undecided", F.col("undecided") > 0)]


def redispatched(covered: Column, failures: Column, unread: Column, new_places: Column, least_new: int, pending: Column) -> Column:
    """Whether a scope goes out again."""
    return ~covered | (failures > 0) | (unread > 0) | (new_places >= least_new) | pending


def coverage_upkeep(events: DataFrame, scope: str, order: str, state: str, closing: Column) -> DataFrame:
    """One row a scope, made when it is first met: its last state, beats that add up, and whether it still stands."""
    return events.groupBy(scope).agg(F.max_by(state, order).alias("state"), F.count("*").alias("beats"), (F.count_if(closing) == 0).alias("keeps"))


# --- jobs -------------------------------------------------------------------------------------------------------------
def state_fold(events: DataFrame, run: str, seq: str, state: str, ends: Column) -> DataFrame:
    """Each run's state, revision and writes; what comes after the first end is absorbed."""
    end = F.min(F.when(ends, F.col(seq))).over(Window.partitionBy(run))
    kept = events.withColumn("__end", end).filter(F.col("__end").isNull() | (F.col(seq) <= F.col("__end")))
    return kept.groupBy(run).agg(F.max(seq).alias("revision"), F.max_by(state, seq).alias("state"), F.count("*").alias("writes"))


def compared_and_set(jobs: DataFrame, writes: DataFrame) -> DataFrame:
    """`jobs` (job_id, state, revision) after `writes` (job_id, expected_state, expected_revision, state, bump), one a job at most (the
    first by expected revision): a write counts if what it expects holds (null expects nothing). applied tells."""
    one = rows.first_by(writes, ["job_id"], F.col("expected_revision").asc_nulls_last(), F.col("state"))
    w = one.select("job_id", "expected_state", "expected_revision", F.col("state").alias("__to"), "bump")
    fits = F.col("__to").isNotNull() & (F.col("expected_state").isNull() | (F.col("expected_state") == F.col("state"))) & (F.col("expected_revision").isNull() | (F.col("expected_revision") == F.col("revision")))
    told = jobs.join(w, "job_id", "left").withColumn("applied", F.coalesce(fits, F.lit(False)))
    return told.select("job_id", F.when(F.col("applied"), F.col("__to")).otherwise(F.col("state")).alias("state"), F.when(F.col("applied") & F.coalesce("bump", F.lit(True)), F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"), "applied")


def created_once(jobs: DataFrame, fingerprint: str, job: str) -> DataFrame:
    """The first job of each fingerprint."""
    return jobs.groupBy(fingerprint).agg(F.min(job).alias("job"))


def submitted(existing: DataFrame, submissions: DataFrame, retry: tuple[str, ...] = ("failed", "canceled")) -> DataFrame:
    """What becomes of submissions (fingerprint, job_id, force): created where there is no job of the fingerprint (existing: fingerprint,
    state), redriven where it has ended badly or, with force, ended at all, else a duplicate. Of several for one fingerprint the first
    counts, the others are duplicates."""
    turn = F.row_number().over(Window.partitionBy("fingerprint").orderBy("job_id"))
    told = submissions.withColumn("__turn", turn).join(existing.select("fingerprint", F.col("state").alias("__had")), "fingerprint", "left")
    ended = F.col("__had").isin("succeeded", "failed", "canceled")
    outcome = F.when(F.col("__turn") > 1, "duplicate").when(F.col("__had").isNull(), "created").when(F.col("__had").isin(*retry) | (F.coalesce("force", F.lit(False)) & ended), "redriven").otherwise("duplicate")
    return told.select("fingerprint", "job_id", outcome.alias("outcome"))


def orphans(queued: DataFrame, live: DataFrame, key: str, live_key: str) -> DataFrame:
    """Jobs that are to be taken up at the start: queued or running without anything alive that has them."""
    return queued.join(live.select(F.col(live_key).alias("__live")), queued[key] == F.col("__live"), "left_anti")


def stale(last: DataFrame, now: Column, ended: Column, fresh_seconds: int, most_attempts: int) -> Column:
    """What to do about a job by its last beat: skipped if it has ended, recovered if the beat is fresh, requeued while attempts are
    left, else failed."""
    from ..functions import scalars

    return F.when(ended, "skipped").when(F.floor(scalars.seconds_since(last["beat"], now)) < fresh_seconds, "recovered").when(last["attempts"] < most_attempts, "requeued").otherwise("failed")


def beaten(jobs: DataFrame, beats: DataFrame) -> DataFrame:
    """Jobs (job_id, state, revision, beat) after beats (job_id, at): the beat moves forward, the revision stays; ended jobs take none."""
    last = beats.groupBy("job_id").agg(F.max("at").alias("__at"))
    from .views import TERMINAL

    return jobs.join(last, "job_id", "left").withColumn("beat", F.when(F.col("state").isin(*TERMINAL), F.col("beat")).otherwise(F.greatest("beat", "__at"))).drop("__at")


def expired(jobs: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Jobs that are left after their time: only ended ones expire."""
    from .views import TERMINAL

    old = F.col("state").isin(*TERMINAL) & (F.unix_timestamp(now) - F.unix_timestamp("beat") >= ttl_seconds)
    return jobs.filter(~F.coalesce(old, F.lit(False)))


def claimed(entries: DataFrame, acked: DataFrame, consumers: int, count: int, most: int | None = None) -> DataFrame:
    """Which consumer (from 0) each of the oldest entries (entry_id) that aren't acknowledged goes to, `count` in turn. With `most` older
    entries than the newest so many are trimmed. Claiming again before an acknowledgement gives the same, so delivery is at least once."""
    live = entries if most is None else entries.orderBy(F.desc("entry_id")).limit(most)
    open_ = live.join(acked.select("entry_id").distinct(), "entry_id", "left_anti").orderBy("entry_id").limit(consumers * count)
    return rows.ordinal(open_, "__at", F.col("entry_id")).withColumn("consumer", F.floor(F.col("__at") / count).cast("int")).drop("__at")


def work_closed(events: DataFrame, run: str, order: str, steps: str, state: Column) -> DataFrame:
    """Work items as they end: the greatest and the summed steps (ledgers differ in which they keep) and their state."""
    return events.groupBy(run).agg(F.max(steps).alias("max_steps"), F.sum(steps).alias("sum_steps"), state.alias("state"))


def last_matching(events: DataFrame, run: str, order: str, match: Column, reason: str, most: int | None = None) -> DataFrame:
    """Each run's last matching step, and the distinct reasons, the first `most` by name."""
    reasons = F.array_sort(F.collect_set(reason))
    return events.groupBy(run).agg(F.max(F.when(match, F.col(order))).alias("last"), F.array_join(reasons if most is None else F.slice(reasons, 1, most), ",").alias("reasons"))


def stopped_early(runs: DataFrame, run: str, order: str, reason: str, finished: str) -> DataFrame:
    """Runs whose last reason isn't the one of a finished run, with how far they came."""
    return runs.groupBy(run).agg(F.max(order).alias(f"{order}s"), F.max_by(reason, order).alias("__reason")).filter(F.col("__reason") != finished).drop("__reason")


def progress(events: DataFrame, run: str, order: str, kind: str, kinds: list[str], *counters: str) -> DataFrame:
    """Counters of each run's last stage or summary event: a later one overwrites, nothing is added up."""
    return latest_by(events.filter(F.col(kind).isin(*kinds)), run, order, *counters)


def capability_gate(degradations: DataFrame, area: str, language_server: Column) -> DataFrame:
    """Whether a language server contributed to an area, and how many of its rows come from one."""
    return degradations.groupBy(area).agg(F.bool_or(language_server).alias("gate"), F.count_if(language_server).alias("kept"))


def assembled(degradations: DataFrame, methods: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts of a manifest: degradations (bundle, capability ...) about language servers go where one contributed (methods: bundle,
    provider), methods are distinct and edges stay as the contexts have them."""
    served = methods.filter(F.startswith("provider", F.lit("lsp_"))).select("bundle").distinct().withColumn("__served", F.lit(True))
    kept = degradations.join(served, "bundle", "left").filter(F.col("__served").isNull() | ~F.startswith("capability", F.lit("lsp"))).drop("__served")
    return kept, methods.dropDuplicates(["bundle", "method_id"]), edges


def stages(events: DataFrame, run: str, stage: str, at: str, starts: Column, ends: Column, *counters: str) -> DataFrame:
    """Each run's stages: when they first started and last ended, whether they go on, and the counters that the last end carries."""
    last = F.when(ends, F.col(at))
    told = events.groupBy(run, stage).agg(F.min(F.when(starts, F.col(at))).alias("started"), F.max(last).alias("ended"), *[F.max_by(c, last).alias(c) for c in counters])
    return told.withColumn("running", F.col("started").isNotNull() & (F.col("ended").isNull() | (F.col("ended") < F.col("started"))))
