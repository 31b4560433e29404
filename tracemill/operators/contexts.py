"""Contexts of a bundle: slices around findings merged by their focus method, and views of them with what they name.

Tables share a key `bundle`. A slice is what was found around one method, its focus; slices of one focus are one context. All
steps are equi-joins and aggregates that combine before the shuffle; a method or bundle that a third of the rows have is dealt
to several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from . import skew, texts
from .store import materialised

#: Fixed value: the rank of a severity that isn't known.
NO_SEVERITY = 4


def references(slices: DataFrame, refs: DataFrame) -> DataFrame:
    """bundle, focus, method_id, depth and slice: of each method of a context the reference of least depth, the first slice's among
    equals. slices: bundle, slice (a number that orders them), focus; refs: bundle, slice, method_id, depth."""
    of = refs.select("bundle", "slice", "method_id", "depth").join(slices.select("bundle", "slice", "focus"), ["bundle", "slice"])
    return of.groupBy("bundle", "focus", "method_id").agg(F.min("depth").alias("depth"), F.min_by("slice", F.struct("depth", "slice")).alias("slice"))


def inlined(references: DataFrame, bodies: DataFrame) -> DataFrame:
    """bundle, focus, method_id and aliases: methods of a context whose body stands in it, and the other methods with the same
    bytes, whose bodies don't. The smallest method_id has the body. bodies: bundle, method_id, content_hash."""
    had = skew.keyed_join(references.select("bundle", "focus", "method_id"), bodies.select("bundle", "method_id", "content_hash"), ["bundle", "method_id"], "inner", ("focus",))
    same = had.groupBy("bundle", "focus", "content_hash").agg(F.array_sort(F.collect_set("method_id")).alias("m"))  # methods of one context
    return same.select("bundle", "focus", F.col("m")[0].alias("method_id"), F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(0))).alias("aliases"))


def discovered(slices: DataFrame, named: DataFrame, findings: DataFrame) -> DataFrame:
    """bundle, focus, finding_id and rank (of its severity; null where there is no such finding) of each finding named: written, as contexts are
    ranked and identified by it."""
    rank = findings.groupBy("bundle", "finding_id").agg(F.min(scalars.severity_rank(F.col("severity"), NO_SEVERITY)).alias("rank"))
    told = skew.keyed_join(materialised(named.select("bundle", "slice", "finding_id")), rank, ["bundle", "finding_id"], "left", ("slice",))
    return materialised(told.join(slices.select("bundle", "slice", "focus"), ["bundle", "slice"]).select("bundle", "focus", "finding_id", "rank"))


def ranked(slices: DataFrame, named: DataFrame, findings: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """Each (bundle, focus) with slices, discoverable (findings named), known (of them in `findings`), worst (severity rank, 0 the
    worst) and the first slice's syntax, path and line, by which contexts are sorted (SO-2): many slices first, then those whose
    focus isn't only a guess of syntax, the worst severity, path and line; method ids decide what is left.

    slices: bundle, slice, focus, path, line, provider; named: bundle, slice, finding_id (repeats count); findings: bundle,
    finding_id, severity; told: what `discovered` gives of them, if it is there already."""
    told = discovered(slices, named, findings) if told is None else told
    first = F.min_by(F.struct(F.when(F.col("provider") == "syntax_regex", 1).otherwise(0).alias("syntax"), "path", "line"), "slice").alias("f")
    groups = slices.groupBy("bundle", "focus").agg(F.count("*").alias("slices"), first)
    sums = told.groupBy("bundle", "focus").agg(F.count("*").alias("discoverable"), F.count("rank").alias("known"), F.min("rank").alias("worst"))
    both = groups.join(sums, ["bundle", "focus"], "left").na.fill(0, ["discoverable", "known"]).na.fill(NO_SEVERITY, ["worst"])
    return both.select("bundle", "focus", "slices", "discoverable", "known", "worst", "f.syntax", "f.path", "f.line")


def capped(ranked: DataFrame, max_contexts: int) -> DataFrame:
    """`ranked` with place, from 1, of the contexts that a bundle keeps, and null for the others, which are pruned (rule max_contexts).
    Ranks are cut within partitions before they meet, so a bundle of any size moves only `max_contexts` rows a task. `ranked` is read twice
    and so written."""
    ranked = materialised(ranked)
    order = Window.partitionBy("bundle").orderBy(F.desc("slices"), "syntax", "worst", "path", "line", "focus")
    best = ranked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max_contexts).select("bundle", "focus", "place")
    return ranked.join(best, ["bundle", "focus"], "left")


def identified(slices: DataFrame, references: DataFrame, told: DataFrame, length: int = 12) -> DataFrame:
    """bundle, focus and context_id: a digest over the focus, its sorted methods and its sorted known findings (told, as from `discovered`)."""
    key = ["bundle", "focus"]
    known = told.filter("rank is not null")
    rows = slices.select(*key).distinct().select(*key, F.lit(0).alias("kind"), F.col("focus").alias("value"))
    rows = rows.unionByName(references.select(*key, F.lit(1).alias("kind"), F.col("method_id").alias("value"))).unionByName(known.select(*key, F.lit(2).alias("kind"), F.col("finding_id").alias("value")))
    told = texts.streamed_digests(rows.withColumn("value", F.col("value").cast("binary")), key, 3, "value", ["value"], length=length)
    return told.select(*key, F.concat(F.lit("C-"), "digest").alias("context_id"))


def contexts(slices: DataFrame, refs: DataFrame, named: DataFrame, findings: DataFrame, bodies: DataFrame, max_contexts: int) -> DataFrame:
    """The assembled contexts: the columns of `capped`, context_id, methods (how many), bodies (how many stand in it) and aliases (how
    many are told by another's). What they hold is in `references` and `inlined`."""
    least = materialised(references(slices, refs))
    held = inlined(least, bodies).groupBy("bundle", "focus").agg(F.count("*").alias("bodies"), F.sum(F.size("aliases")).alias("aliases"))
    sizes = least.groupBy("bundle", "focus").agg(F.count("*").alias("methods"))
    told = discovered(slices, named, findings)
    whole = capped(ranked(slices, named, findings, told), max_contexts).join(identified(slices, least, told), ["bundle", "focus"])
    return whole.join(sizes, ["bundle", "focus"], "left").join(held, ["bundle", "focus"], "left").na.fill(0, ["methods", "bodies", "aliases"])


def accounted(contexts: DataFrame) -> DataFrame:
    """Per bundle of `capped` contexts: discoverable, bundled, rejected and deduped findings (AG-10) and the ratio of bundled ones, which
    is 1 where there was nothing to find."""
    kept = F.col("place").isNotNull()
    sums = contexts.groupBy("bundle").agg(F.sum("discoverable").alias("discoverable"), F.sum(F.when(kept, F.col("known")).otherwise(0)).alias("bundled"), F.sum(F.when(kept, F.col("slices") - 1).otherwise(0)).alias("deduped"))
    rejected = F.greatest(F.lit(0), F.col("discoverable") - F.col("bundled"))
    return sums.withColumn("rejected", rejected).withColumn("ratio", F.coalesce(F.try_divide("bundled", "discoverable"), F.lit(1.0)))


# --- views ------------------------------------------------------------------------------------------------------------
def finding_views(named: DataFrame, findings: DataFrame) -> DataFrame:
    """bundle, context_id, finding_id, the findings' columns and missing: an id that no finding has keeps its row."""
    marked = findings.withColumn("missing", F.lit(False))
    return skew.keyed_join(named, marked, ["bundle", "finding_id"], "left", ("context_id",)).withColumn("missing", F.coalesce("missing", F.lit(True)))


def edge_views(edges: DataFrame, methods: DataFrame) -> DataFrame:
    """`edges` (bundle, context_id, caller_id, callee_id ...) with caller_name and callee_name: the methods' (bundle, method_id, name), or
    the id itself where there is none."""
    for end in ("caller", "callee"):
        names = methods.select("bundle", F.col("method_id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name"))
        edges = skew.keyed_join(materialised(edges), names, ["bundle", f"{end}_id"], "left", ("context_id",)).withColumn(f"{end}_name", F.coalesce(f"{end}_name", f"{end}_id"))
    return edges


def prune_views(contexts: DataFrame, members: DataFrame, prunes: DataFrame, most_broadcast: int = 10_000) -> DataFrame:
    """context_id and the columns of the prunes that concern it: those of its focus or of one of its methods, and those of its bundle
    without a method, which concern every context. Each prune comes once a context.

    contexts: bundle, context_id, focus; members: bundle, context_id, method_id; prunes: bundle, method_id, other columns. Methods without a
    prune are left out before they are made distinct, and the others written, as `dealt_join` counts them first."""
    own = members.select("bundle", "context_id", "method_id").unionByName(contexts.select("bundle", "context_id", F.col("focus").alias("method_id")))
    named = prunes.filter("method_id is not null").select("bundle", "method_id")
    own = materialised(own.join(named, ["bundle", "method_id"], "left_semi").repartition("bundle", "context_id", "method_id").distinct())
    of = skew.dealt_join(own, prunes.filter("method_id is not null"), ["bundle", "method_id"], most_broadcast, ("context_id",))
    whole = skew.dealt_join(contexts.select("bundle", "context_id"), prunes.filter("method_id is null"), ["bundle"], most_broadcast, ("context_id",))
    columns = ["bundle", "context_id", *[c for c in prunes.columns if c != "bundle"]]
    return of.select(*columns).unionByName(whole.select(*columns))


def degradations(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Degradations once a key, the first by `order`: the key is (capability, reason) in a manifest and reason alone in an index of symbols. An
    aggregate that combines before the shuffle, so a reason that most rows have is one row a task."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("__first")).select(*keys, "__first.*")
