"""Aggregations of the screens and ledgers. Each is one partial aggregate and a small shuffle; windows run over aggregated rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, places: int = 6) -> Column:
    """part / whole, null where there is no whole."""
    return F.round(F.try_divide(part.cast("double"), F.nullif(whole, F.lit(0)).cast("double")), places)


def histogram(df: DataFrame, *keys: str | Column, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def scan_counts(findings: DataFrame, *keys: str) -> DataFrame:
    """Findings by keys, with the number of paths."""
    return findings.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths"))


def top_paths(findings: DataFrame, most: int = 10) -> DataFrame:
    return histogram(findings, "path").orderBy(F.desc("n"), "path").limit(most)


def suspicious_zero(findings: DataFrame, failed: Column | None = None) -> DataFrame:
    """n and suspicious: no findings at all (and, with `failed`, a scan that failed, wasn't set up or ended oddly)."""
    return findings.agg(F.count("*").alias("n")).withColumn("suspicious", (F.col("n") == 0) & (F.lit(True) if failed is None else failed))


def timeline_share(stages: DataFrame, stage: str, amount: str) -> DataFrame:
    """stage, amount and its share of the whole; the whole counts as 1 where it is 0."""
    each = stages.groupBy(stage).agg(F.sum(amount).alias(amount))
    total = F.coalesce(F.nullif(F.sum(amount).over(Window.partitionBy()), F.lit(0)), F.lit(1))  # a row a stage
    return each.withColumn("share", F.round(F.col(amount).cast("double") / total.cast("double"), 6))


def counted_by_both(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Rows of either side by key; what one side lacks counts as 0."""
    return histogram(left, key, name=names[0]).join(histogram(right, key, name=names[1]), key, "full_outer").na.fill(0, list(names))


def provider_stats(methods: DataFrame, edges: DataFrame) -> DataFrame:
    """provider with its methods and edges."""
    return counted_by_both(methods, edges, "provider", ("methods", "edges"))


def deltas(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Counters of two bundles (key, n) side by side over the union of their keys, and what the right one has more."""
    both = left.withColumnRenamed("n", "left_n").join(right.withColumnRenamed("n", "right_n"), key, "full_outer").na.fill(0, ["left_n", "right_n"])
    return both.withColumn("delta", F.col("right_n") - F.col("left_n"))


def listed_counts(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """One text a group: value:count in the order of values."""
    n = histogram(df, group, value)
    pairs = F.array_sort(F.collect_list(F.struct(value, "n")))
    return n.groupBy(group).agg(F.array_join(F.transform(pairs, lambda p: F.concat(p[value].cast("string"), F.lit(":"), p["n"].cast("string"))), ",").alias(name))


def census(files: DataFrame, kind: str, asked: list[str] | None = None) -> DataFrame:
    """kind and n, with zero rows for what was asked and isn't there; dominant marks the kind with most files, the smallest name among
    equals, and none where there are no files."""
    each = histogram(files, kind)
    if asked:
        axis = files.sparkSession.createDataFrame([(a,) for a in asked], f"{kind} string")
        each = each.unionByName(axis.join(each, kind, "left_anti").withColumn("n", F.lit(0).cast("long")))
    best = each.filter("n > 0").agg(F.min_by(kind, F.struct(-F.col("n"), F.col(kind))).alias("__best"))
    return each.crossJoin(F.broadcast(best)).select(kind, "n", F.coalesce(F.col(kind) == F.col("__best"), F.lit(False)).alias("dominant"))  # best is one row


def measured(files: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Files and bytes of each tree."""
    return files.groupBy(by).agg(F.count("*").alias("files"), F.sum(F.octet_length(text)).cast("long").alias("bytes"))


def coverage_totals(bundles: DataFrame, workspace: str, sums: list[str], counts: dict[str, Column]) -> DataFrame:
    """One row over bundles: their number, distinct workspaces, sums (null as 0) and conditional counts."""
    return bundles.agg(F.count("*").alias("bundles"), F.count_distinct(workspace).alias("workspaces"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in sums], *[F.count_if(c).alias(n) for n, c in counts.items()])


def share_of_units(df: DataFrame, unit: str, value: str, name: str | None = None) -> DataFrame:
    """For each value the number of units that have it, once each, and its share of all units."""
    name = name or value
    n = df.select(unit, F.col(value).alias(name)).distinct().groupBy(name).agg(F.count("*").alias("n"))
    total = df.agg(F.count_distinct(unit).alias("__total"))
    return n.crossJoin(F.broadcast(total)).select(name, "n", F.round(F.col("n") / F.col("__total"), 6).alias("share"))  # the total is one row


def ai_totals(calls: DataFrame, by: list[str], prompt: str, cached: str) -> DataFrame:
    """Prompt and cached tokens with the share of cached ones (null without prompt tokens), and how many calls reported any."""
    hit = F.sum(cached)
    return calls.groupBy(*by).agg(F.sum(prompt).alias("prompt"), hit.alias("cached"), ratio(hit, F.sum(prompt)).alias("cache_share"), F.count(prompt).alias("reported"))


def traffic_by_endpoint(rows: DataFrame, path: str, amount: str, failed: Column, seen: str, top: int) -> DataFrame:
    """The endpoints with most rows, first seen first among equals: n, mean, errors and when they were seen first."""
    each = rows.groupBy(path).agg(F.count("*").alias("n"), F.round(F.avg(amount), 4).alias(f"mean_{amount}"), F.count_if(failed).alias("errors"), F.min(seen).alias("first_seen"))
    return each.orderBy(F.desc("n"), "first_seen").limit(top)


def first_attempts(calls: DataFrame, caller: str, attempt: str, failed: Column, amount: str) -> DataFrame:
    """Each caller's least attempt, calls, failures and amount."""
    return calls.groupBy(caller).agg(F.min(attempt).alias("least"), F.count("*").alias("n"), F.count_if(failed).alias("failures"), F.sum(amount).alias(amount))


def model_call_totals(calls: DataFrame, caller: str, attempt: str, failed: Column, amount: str) -> DataFrame:
    """attempts, failures, callers, retried (attempts beyond each caller's first number) and amount."""
    c = first_attempts(calls, caller, attempt, failed, amount)
    return c.agg(F.sum("n").alias("attempts"), F.sum("failures").alias("failures"), F.count("*").alias("callers"), F.greatest(F.lit(0), F.sum("n") - F.sum("least")).alias("retried"), F.sum(amount).alias(amount))


def on_axis(df: DataFrame, kind: str, axis: list[str], counts: dict[str, Column], name: str = "kind") -> DataFrame:
    """Conditional counts for the kinds of the axis only, 0 where there is nothing; other kinds are dropped."""
    asked = df.sparkSession.createDataFrame([(a,) for a in axis], f"{name} string")
    each = df.filter(F.col(kind).isin(*axis)).groupBy(F.col(kind).alias("__kind")).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    return F.broadcast(asked).join(each, F.col(name) == F.col("__kind"), "left").drop("__kind").na.fill(0)


def queue_health(jobs: DataFrame, queued: Column, pending: Column, lag: Column | None = None) -> DataFrame:
    """queued, pending and degraded: more wait than the queue's lag and what is pending explain."""
    q, p = F.count_if(queued), F.count_if(pending)
    return jobs.agg(q.alias("queued"), p.alias("pending"), (q > p + (F.lit(0) if lag is None else F.count_if(lag))).alias("degraded"))


def trail_counters(events: DataFrame, kinds: dict[str, Column], run: str = "run", seq: str = "seq") -> DataFrame:
    return events.agg(F.count("*").alias("events"), F.count_distinct(run).alias("runs"), *[F.count_if(c).alias(n) for n, c in kinds.items()], F.max(seq).alias("last_seq"))


def rejected_by_place(candidates: DataFrame, place: list[str], kind: str, reason: Column | None = None) -> DataFrame:
    """Rejected candidates of each place: n, their kinds and, with `reason`, the first one that isn't empty."""
    more = [] if reason is None else [F.first(F.nullif(reason, F.lit("")), True).alias("reason")]
    return candidates.groupBy(*place).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"), *more)


def first_breach(calls: DataFrame, run: str, seq: str, caps: list[tuple[str, Column, float]]) -> DataFrame:
    """Where each run's running sums first exceed a cap, and which: caps (name, amount, most) are asked in order."""
    w = Window.partitionBy(run).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    cap = F.when(F.lit(False), "")
    for name, amount, most in caps:
        cap = cap.when(F.sum(F.coalesce(amount, F.lit(0))).over(w) > most, name)
    return calls.withColumn("cap", cap).filter("cap is not null").groupBy(run).agg(F.min(seq).alias("breach_seq"), F.min_by("cap", F.struct(seq, "cap")).alias("cap"))


def spent(prompt: Column, completion: Column, per_million_in: float, per_million_out: float) -> Column:
    """The cost of a call; null where usage is unknown."""
    return (prompt * per_million_in + completion * per_million_out) / 1e6


def bundle_totals(blocks: DataFrame, by: str, chars: str) -> DataFrame:
    """Characters of each bundle's blocks, and of their text joined by line ends."""
    return blocks.groupBy(by).agg(F.sum(chars).alias("chars"), (F.sum(chars) + F.count("*") - 1).alias("joined"))


def distinct_in_order(df: DataFrame, by: str, value: str, order: str, name: str = "values") -> DataFrame:
    """Each group's non-empty values by where they are seen first."""
    first = df.filter(F.coalesce(F.col(value).cast("string"), F.lit("")) != "").groupBy(by, value).agg(F.min(order).alias("__at"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", value))), lambda p: p[value]).alias(name))


def method_index(methods: DataFrame, refs: DataFrame, key: str, context: str, depth: str, focus: Column) -> DataFrame:
    """Each method with the contexts that hold it, its least depth and the findings it has as a focus."""
    each = refs.groupBy(key).agg(F.count_distinct(context).alias("contexts"), F.min(depth).alias("min_depth"), F.count_if(focus).alias("focus_findings"))
    return methods.join(each, key, "left").na.fill(0, ["contexts", "focus_findings"])


def pages_of(jobs: DataFrame, limit: int, keep: Column, *order: Column, over_read: int = 4) -> DataFrame:
    """A page that is filtered after reading: the newest over_read * limit rows, and of these the ones to keep, at most limit."""
    return jobs.orderBy(*order).limit(over_read * limit).filter(keep).orderBy(*order).limit(limit)


def overview(rows: DataFrame, by: list[str], top: tuple[str, list[str]], flags: dict[str, Column], axis: tuple[str, int]) -> DataFrame:
    """Per bundle the number of its contexts, the value of the top one (column, order), for each flag how many rows have it and whether any has,
    and whether all values of an axis (column, how many there are) occur."""
    column, order = top
    counts = [x for name, flag in flags.items() for x in (F.count_if(flag).alias(name), (F.count_if(flag) > 0).alias(f"has_{name}"))]
    return rows.groupBy(*by).agg(F.count("*").alias("contexts"), F.max_by(column, F.struct(*order)).alias("top"), *counts, (F.count_distinct(axis[0]) == axis[1]).alias("all_values"))


def funnel(counts: DataFrame, steps: list[tuple[str, str, str]]) -> DataFrame:
    """step, name, count, of_previous, of_first and lost of the steps (name, column of its count, column of what it is compared with) of a table of
    one row. Shares of nothing are null."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.col(count).cast("long").alias("count"), F.col(before).cast("long").alias("previous")) for i, (name, count, before) in enumerate(steps, 1)]))
    told = counts.select(F.col(steps[0][1]).alias("__first"), each.alias("s")).select("__first", "s.*")

    def share(of: str) -> Column:
        return F.round(F.try_divide(F.col("count").cast("double"), F.col(of).cast("double")), 6)

    return told.select("step", "name", "count", share("previous").alias("of_previous"), share("__first").alias("of_first"), F.greatest(F.col("previous") - F.col("count"), F.lit(0).cast("long")).alias("lost"))


def run_counters(slices: DataFrame, run: str, method: str, slice_id: str) -> DataFrame:
    """Per run of rows (run, slice, method): slices, methods (each once) and methods_in_slices (each once a slice).

    Rows are dealt by number before they are made distinct, so no task holds the keys of a whole split."""
    n = int(slices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = slices.select(run, slice_id, method).repartition(n, run, slice_id, method).distinct()
    return once.groupBy(run).agg(F.count_distinct(slice_id).alias("slices"), F.count_distinct(method).alias("methods"), F.count("*").alias("methods_in_slices"))
