"""Keyed ledgers of an audit: candidates, plans, leads, gaps, claims and records. A keyed upsert is one aggregate by its id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars


def ledger_id(*parts: Column, between: str | None = None, length: int = 20) -> Column:
    """The id of a row of a ledger: the beginning of a sha256 over its parts, each ended by NUL, or joined by `between`."""
    text = F.concat(*[x for p in parts for x in (p.cast("string"), F.lit("\0"))]) if between is None else F.concat_ws(between, *[p.cast("string") for p in parts])
    return F.substring(F.sha2(text, 256), 1, length)


def parsed_candidates(answers: DataFrame, keys: list[str], order: str, whole: Column, first: str) -> DataFrame:
    """Candidates of answers: rows that aren't whole are dropped, the first of each key stays (`first`: its order), with its id."""
    kept = answers.filter(whole).groupBy(*keys).agg(F.min(order).alias(first))
    return kept.withColumn("id", ledger_id(*map(F.col, keys)))


def plan_rows(rows: DataFrame, texts: list[str], priority: str, files: str) -> DataFrame:
    """Rows of a plan that are whole: every text is there, the priority is 1 to 3, and there are files."""
    whole = F.col(priority).between(1, 3) & (F.size(F.coalesce(files, F.array().cast("array<string>"))) > 0)
    for t in texts:
        whole = whole & (F.trim(F.coalesce(t, F.lit(""))) != "")
    return rows.filter(whole)


def answered(claims: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Claims with how many answers they have; absent marks those without any, which isn't a no."""
    n = answers.groupBy(key).agg(F.count("*").alias("answered"))
    return claims.join(n, key, "left").withColumn("absent", F.col("answered").isNull())


def valid_scopes(scopes: DataFrame, inventory: DataFrame, scope: str, file: str, reserved: list | None = None) -> DataFrame:
    """Scopes (a row a file) with their files and whether they are valid: all files are in the inventory and the id isn't reserved."""
    known = inventory.select(F.col(file).alias("__file")).distinct().withColumn("__known", F.lit(True))
    told = scopes.join(known, scopes[file] == F.col("__file"), "left")
    free = ~F.first(F.col(scope)).isin(*reserved) if reserved else F.lit(True)
    return told.groupBy(scope).agg(F.count("*").alias("files"), ((F.count_if(F.col("__known").isNull()) == 0) & free).alias("valid"))


def batch_commit(decisions: DataFrame, batch: str, valid: Column) -> DataFrame:
    """Batches of decisions: one that isn't valid rejects its whole batch."""
    ok = F.bool_and(valid)
    return decisions.groupBy(batch).agg(F.count("*").alias("leads"), ok.alias("commits"), F.when(ok, F.count("*")).otherwise(0).alias("written"))


def lead_effects(decisions: DataFrame, work: DataFrame) -> DataFrame:
    """Decisions (batch, lead, sequence, pending_sequence, pending, action, question, files) of batches that commit, with effect: stale if the
    lead has changed, reused where `work` (work_id, question, files) has the same question, case aside, with the same set of
    files, else the action."""
    twin = work.select("work_id", F.lower(F.trim("question")).alias("__q"), F.array_sort(F.array_distinct("files")).alias("__f")).groupBy("__q", "__f").agg(F.min("work_id").alias("work_id"))
    own = decisions.withColumn("__q", F.lower(F.trim("question"))).withColumn("__f", F.array_sort(F.array_distinct("files")))
    told = own.join(twin, ["__q", "__f"], "left")
    stale = ~F.coalesce("pending", F.lit(False)) | (F.col("sequence") != F.col("pending_sequence"))
    effect = F.when(stale, "stale").when((F.col("action") == "create") & F.col("work_id").isNotNull(), "reused").otherwise(F.col("action"))
    return told.select("batch", "lead", effect.alias("effect"), F.when(effect == "reused", F.col("work_id")).alias("work_id"))


def upserted_gaps(gaps: DataFrame, keys: list[str], resolved: Column, ref: str) -> DataFrame:
    """Gaps by id: resolved stays once it is, evidence references are joined, sorted."""
    g = gaps.groupBy(*keys).agg(F.max(F.when(resolved, 1).otherwise(0)).alias("resolved"), F.array_join(F.array_sort(F.collect_set(F.col(ref).cast("string"))), ",").alias("refs"))
    return g.withColumn("gap", ledger_id(*map(F.col, keys), between="|"))


def stalled(before: DataFrame, after: DataFrame, key: str, measures: list[str], attempts: str, most: int) -> DataFrame:
    """Work (key) whose measures haven't moved since before, and blocked where it has been tried too often."""
    a, b = after.alias("a"), before.alias("b")
    same = F.lit(True)
    for m in measures:
        same = same & F.col(f"a.{m}").eqNullSafe(F.col(f"b.{m}"))
    told = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "left")
    none = F.col(f"b.{key}").isNotNull() & same
    return told.select(F.col(f"a.{key}"), none.alias("no_progress"), (none & (F.col(f"a.{attempts}") >= most)).alias("blocked"))


def claim_work(claims: DataFrame, keys: list[str], file: str, most_attempts: int) -> DataFrame:
    """One work item a claim: its distinct files, sorted, blocked once there are `most_attempts` attempts (rows)."""
    return claims.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(F.col(file).cast("string"))), ",").alias("files"), (F.count("*") >= most_attempts).alias("blocked"))


def recorded(records: DataFrame, inventory: DataFrame, file: str, inventory_file: str, kinds: Column) -> DataFrame:
    """Records of known kinds whose place is in the inventory; others are refused."""
    return records.filter(kinds).join(inventory.select(F.col(inventory_file).alias("__file")), records[file] == F.col("__file"), "left_semi")


def evidence_ids(records: DataFrame, *parts: str) -> DataFrame:
    return records.withColumn("evidence_id", ledger_id(*map(F.col, parts)))


def routed(records: DataFrame, ledgers: dict[str, list[str]], kind: str = "kind") -> dict[str, DataFrame]:
    """Records by the ledger that their kind goes to; kinds of no ledger are refused."""
    return {name: records.filter(F.col(kind).isin(*kinds)) for name, kinds in ledgers.items()}


def sections(rows: DataFrame, by: str, item: str, most: int) -> DataFrame:
    """Sections of a board: how many items each shows and how many it leaves out."""
    items = scalars.bounded(F.array_sort(F.collect_list(item)), most)
    return rows.groupBy(by).agg(items.alias("__b")).select(by, F.size("__b.items").cast("long").alias("shown"), F.col("__b.omitted").cast("long").alias("omitted"))


def findings_index(rows: DataFrame, by: str, most: int, yes: Column, no: Column) -> DataFrame:
    """Findings with the number of their rows, how many a list of `most` leaves out, and three-valued reachability."""
    reachable = F.when(yes, "yes").when(no, "no").otherwise("no conclusion")
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.greatest(F.count("*") - most, F.lit(0)).alias("omitted"), reachable.alias("reachable"))


def frontend(census: DataFrame, kind: str, frontends: dict[str, str]) -> DataFrame:
    """The frontend of the dominant kind of files; a kind without one is refused (null), never an empty graph."""
    return census.filter("dominant").select(kind, scalars.lookup(F.col(kind), frontends).alias("frontend"))
