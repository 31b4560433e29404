"""Joins of the bundle: containment, lookups, verdicts and registries. All are equi-joins; ranges are residual conditions within a
file, cut into bins so that a file with many rows isn't one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rows

#: Lines of one bin of a file.
BIN = 64


def contained(points: DataFrame, ranges: DataFrame, path: str, point: str, start: str, end: str) -> DataFrame:
    """Each point with each range of its path that holds it. A range stands in every bin that it touches, a point in its own, so the
    join key is (path, bin) and a pair is met once."""
    binned = ranges.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor(F.greatest(start, end) / BIN))))
    at = points.withColumn("__bin", F.floor(F.col(point) / BIN))
    return at.join(binned, [path, "__bin"]).filter((F.col(point) >= F.col(start)) & (F.col(point) <= F.col(end))).drop("__bin")


def innermost(points: DataFrame, ranges: DataFrame, path: str, point: str, start: str, end: str, keep: list[str], *order: Column) -> DataFrame:
    """Each distinct (path, point) with columns `keep` of the best range that holds it, by `order`: a min_by that combines before
    the shuffle, over places instead of rows."""
    places = points.select(path, point).distinct()
    inside = contained(places, ranges, path, point, start, end)
    return inside.groupBy(path, point).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("__best")).select(path, point, "__best.*")


def containing_chain(points: DataFrame, ranges: DataFrame, path: str, point: str, start: str, end: str, name: str, order: str, keys: list[str], between: str = ">") -> DataFrame:
    """For each point (keys) the depth and the chain of names of the ranges that hold it, the widest first."""
    inside = contained(points.select(*keys, path).distinct(), ranges, path, point, start, end)
    each = F.array_sort(F.collect_list(F.struct((F.col(start) - F.col(end)).alias("s"), order, name)))  # as many as ranges nest
    return inside.groupBy(*keys).agg(F.count("*").alias("depth"), F.array_join(F.transform(each, lambda x: x[name]), between).alias("chain"))


def widest_start(points: DataFrame, ranges: DataFrame, path: str, point: str, start: str, end: str, name: str, order: str, keys: list[str]) -> DataFrame:
    """For each point (keys) the range that holds it and begins last. Points are dealt by number before they are made distinct, so no task
    holds those of a whole split."""
    from . import skew

    inside = contained(skew.dealt(points.select(*keys, path), *keys, path).distinct(), ranges, path, point, start, end)
    return inside.groupBy(*keys).agg(F.max_by(name, F.struct(start, order)).alias(name))


def first_of(df: DataFrame, key: str, columns: list[str], *order: str) -> DataFrame:
    """Each key with columns of its first row in order: a point lookup for every key at once."""
    return df.groupBy(key).agg(*[F.min_by(c, F.struct(*order)).alias(c) for c in columns])


def confirmed(candidates: DataFrame, verdicts: DataFrame, key: str, verdict_key: str, verdict: Column) -> DataFrame:
    """Candidates with such a verdict, as they are."""
    return candidates.join(verdicts.filter(verdict).select(F.col(verdict_key).alias("__key")), candidates[key] == F.col("__key"), "left_semi")


def rejected(candidates: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Candidates (key) with a verdict (key, verdict, reason) that isn't confirmed."""
    return candidates.join(verdicts.filter("verdict != 'confirmed'").select(key, "verdict", "reason"), key)


def pending(candidates: DataFrame, verdicts: DataFrame, claim: list[str], key: str) -> DataFrame:
    """Candidates (key, claim columns) without a verdict (key, verdict), with inherited: the first decided verdict of their claim, by key;
    null where the claim has none, and these are to be judged, one a claim. Nulls in a claim are equal."""
    told = candidates.join(verdicts.select(key, "verdict"), key, "left")
    known = told.filter("verdict is not null").groupBy(*claim).agg(F.min_by("verdict", key).alias("inherited"))
    open_ = told.filter("verdict is null").drop("verdict")
    same = F.lit(True)
    for c in claim:
        same = same & open_[c].eqNullSafe(known[c])
    return open_.join(known, same, "left").select(*[open_[c] for c in open_.columns], "inherited")


def paths_fanned(members: DataFrame, paths: DataFrame, claim: list[str], key: str) -> DataFrame:
    """Attack paths (key, entry_points, reachable) of some members (key, claim columns, entry_points) for every member of their claim: the path
    is copied and its entry points are joined by the members' own, each once, in order."""
    own = members.join(paths.select(key, F.col("entry_points").alias("__path"), "reachable"), key)
    by = own.groupBy(*claim).agg(F.min_by(F.struct("__path", "reachable"), key).alias("__given"))
    points = members.groupBy(*claim).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(key, "entry_points"))), lambda m: m["entry_points"])).alias("__points"))
    told = members.select(key, *claim).join(by, claim).join(points, claim)
    return told.select(key, F.array_distinct(F.concat("__given.__path", "__points")).alias("entry_points"), "__given.reachable")


def assembled(confirmed_rows: DataFrame, paths: DataFrame, key: str, path_key: str, columns: list[str], severity: Column, verdict: Column) -> DataFrame:
    """Findings of judged rows: a left join of their paths; the severity is derived from both."""
    side = paths.select(F.col(path_key).alias("__path_key"), *columns)
    return confirmed_rows.join(side, confirmed_rows[key] == F.col("__path_key"), "left").withColumn("verdict", verdict).withColumn("severity", severity)


def projects(bundles: DataFrame, jobs: DataFrame, workspace: str, nothing: str = "(none)") -> DataFrame:
    """Bundles and jobs (workspace, at) by workspace, with a name for none: their numbers and the last activity of jobs."""
    b = bundles.groupBy(F.coalesce(workspace, F.lit(nothing)).alias(workspace)).agg(F.count("*").alias("bundles"))
    j = jobs.groupBy(F.coalesce(workspace, F.lit(nothing)).alias(workspace)).agg(F.count("*").alias("jobs"), F.max("at").alias("last_job"))
    return b.join(j, workspace, "full_outer").na.fill(0, ["bundles", "jobs"])


def recent_activity(df: DataFrame, by: str, at: str) -> DataFrame:
    """Groups by their last activity, newest first (null as the oldest), then by name."""
    return df.groupBy(by).agg(F.max(at).alias("last_activity"), F.count("*").alias("n")).orderBy(F.col("last_activity").desc_nulls_last(), by)


def registered(derived: DataFrame, registry: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Derived rows and the registry's, whose columns win; what is only in the registry stands without the derived columns."""
    return rows.override(derived, registry, key, columns)


def same_name(wanted: DataFrame, known: DataFrame, names: list[str], key: str, near: tuple[str, str], order: str) -> DataFrame:
    """For each wanted row (key) the last definition (other) of its name by `order`, and near_first: the greatest one that is near, else the
    last. near: columns of the wanted and the known side that are equal where a definition is near.

    The known side is summed up to a row a name and a row a (name, nearness) first, so a frequent name makes no pairs; wanted rows of
    frequent names are dealt to several tasks."""
    from . import skew
    from .store import materialised

    own, its = near
    last = known.groupBy(*names).agg(F.max_by("other", F.struct(order, "other")).alias("last_match"))
    close = known.groupBy(*names, F.col(its).alias("__near")).agg(F.max("other").alias("__close"))
    asked = materialised(wanted.select(key, *names, F.col(own).alias("__near")))
    told = skew.keyed_join(asked, last, names, "inner", (key,)).join(close, [*names, "__near"], "left")
    return told.select(key, "last_match", F.coalesce("__close", "last_match").alias("near_first"))


def overlaps(work: DataFrame, item: str, *by: str) -> DataFrame:
    """All pairs a < b of work items that share something, once each. What is shared by n items makes n(n-1)/2 pairs, as the semantics ask for
    (`graph.stars` is linear, where only
    connectedness is needed); rows of frequent things are dealt to several tasks."""
    from . import skew
    from .store import materialised

    once = materialised(work.select(item, *by).distinct())
    a, b = once.withColumnRenamed(item, "a"), once.withColumnRenamed(item, "b")
    return skew.dealt_join(a, b, list(by), spread=("a",)).filter("a < b").select("a", "b").distinct()


def fresh_facts(facts: Column, known: Column) -> Column:
    """Facts (array) that aren't known yet, each once, in order."""
    return F.array_except(facts, known)


def missing_fields(present: Column, required: list[str]) -> Column:
    """Required fields that a row lacks."""
    return F.array_except(F.array(*map(F.lit, required)), present)


def availability(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Expected artifacts with whether they are there now."""
    have = found.select(key).distinct().withColumn("__have", F.lit(True))
    return expected.join(have, key, "left").withColumn("available", F.coalesce("__have", F.lit(False))).drop("__have")


def callees(hierarchy: DataFrame, lexical: DataFrame, defined: DataFrame | None = None) -> DataFrame:
    """Edges (source, target) of a call hierarchy, and for sources that it doesn't know lexical ones: distinct, not to themselves, and
    not to names that the source defines itself."""
    rest = lexical.select("source", "target").distinct().filter("source != target")
    if defined is not None:
        rest = rest.join(defined.select("source", "target"), ["source", "target"], "left_anti")
    unknown = rest.join(hierarchy.select("source").distinct(), "source", "left_anti")
    return hierarchy.select("source", "target", F.lit("hierarchy").alias("via")).unionByName(unknown.withColumn("via", F.lit("lexical")))


def flow_depth(elements: DataFrame, flow: str, at: str, focus: Column, unknown: int = 999) -> DataFrame:
    """Where a flow meets the focus first and last, and how many elements come after."""
    here = F.when(focus, F.col(at))
    return elements.groupBy(flow).agg(F.min(here).alias("first_focus"), F.max(here).alias("last_focus"), (F.max(at) - F.coalesce(F.max(here), F.lit(unknown))).alias("depth"))


def out_degrees(edges: DataFrame) -> DataFrame:
    """Edges with the number of edges of their source; the counts are summed before they move."""
    return edges.join(edges.groupBy("source").agg(F.count("*").alias("out_degree")), "source")


def flow_methods(elements: DataFrame, ranges: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, method and via of each method name of a flow. elements: keys, name, at (their order), path and line (null: not located);
    ranges: path, start, end, method; known: name, method, place.

    The first located element of the name, in flow order, is in a method (innermost), via flow; where none is, the last definition of
    the name by place, via name; else method is null."""
    from . import skew
    from .store import materialised

    held = materialised(elements)
    first = held.filter("path is not null").groupBy(*keys, "name").agg(F.min_by(F.struct("path", "line"), "at").alias("p")).select(*keys, "name", "p.*")
    inside = innermost(first, ranges, "path", "line", "start", "end", ["method"], F.col("end") - F.col("start"), F.col("method"))
    own = first.join(inside, ["path", "line"]).select(*keys, "name", F.col("method").alias("__own"))
    last = known.groupBy("name").agg(F.max_by("method", F.struct("place", "method")).alias("__any"))
    wanted = materialised(held.select(*keys, "name").distinct().join(own, [*keys, "name"], "left"))
    told = skew.keyed_join(wanted, last, ["name"], "left", tuple(keys))
    return told.select(*keys, "name", F.coalesce("__own", "__any").alias("method"), F.when(F.col("__own").isNotNull(), "flow").when(F.col("__any").isNotNull(), "name").alias("via"))


def callers(hierarchy: DataFrame, implementations: DataFrame, references: DataFrame, limit: int) -> DataFrame:
    """Edges (source calls target) with confidence and via, `limit` a target at most. hierarchy: source, target, ord; implementations:
    source (a method), target (what implements it), ord; references: source, target, ord.

    A method that the call hierarchy knows callers of has these first, in order, and then those of its implementations, each caller once; one
    without has those that refer to it, at 0.6. The callers of an implementation are cut to the limit before they meet, so a frequent one
    stays small."""
    from . import skew
    from .store import materialised

    direct = rows.top_per(hierarchy.select("source", "target", "ord"), ["target"], limit, F.col("ord"), F.col("source"))
    direct = materialised(direct)
    known = direct.select("target").distinct()
    impls = rows.top_per(implementations.select(F.col("source").alias("method"), F.col("target").alias("impl"), F.col("ord").alias("nth")), ["method"], limit, F.col("nth"), F.col("impl")).join(known.withColumnRenamed("target", "method"), "method", "left_semi")
    over = skew.dealt_join(materialised(impls), direct.withColumnRenamed("target", "impl"), ["impl"], spread=("method",))
    first = direct.select("source", "target", F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("nth"), F.col("ord").cast("long").alias("ord")).alias("at"))
    more = over.select("source", F.col("method").alias("target"), F.struct(F.lit(1).alias("k"), F.col("nth").cast("long").alias("nth"), F.col("ord").cast("long").alias("ord")).alias("at"))
    once = first.unionByName(more).groupBy("source", "target").agg(F.min("at").alias("at"))
    kept = rows.top_per(once, ["target"], limit, F.col("at"), F.col("source")).select("source", "target", F.lit(1.0).alias("confidence"), F.lit("hierarchy").alias("via"))
    rest = references.select("source", "target", "ord").join(known, "target", "left_anti").groupBy("source", "target").agg(F.min("ord").alias("ord"))
    told = rows.top_per(rest, ["target"], limit, F.col("ord"), F.col("source")).select("source", "target", F.lit(0.6).alias("confidence"), F.lit("references").alias("via"))
    return kept.unionByName(told)
