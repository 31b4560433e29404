"""Views and merges of a board: sections with their items, what concerns one work item, and fragments of a project as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from . import skew
from .store import materialised


def shown(rows: DataFrame, by: list[str], most: int, *order: Column) -> DataFrame:
    """The first `most` rows of each section in order, with omitted: how many more it has. Ranks are cut in partitions before they
    meet, and counts are summed, so a section of any size moves `most` rows a task."""
    kept = rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= most)
    n = rows.groupBy(*by).agg(F.greatest(F.count("*") - most, F.lit(0)).alias("omitted"))
    return kept.join(n, by)


def concerning(rows: DataFrame, work: DataFrame, files: DataFrame) -> DataFrame:
    """work_id (of the work item that looks) and the rows (row, work_id, file ...) that are its own or on one of its files (files:
    work_id, file), each once: a union of two equi-joins instead of a join on either."""
    return seen(rows, work, files).dropDuplicates(["work_id", "row"])


def seen(rows: DataFrame, work: DataFrame, files: DataFrame) -> DataFrame:
    """`concerning` with a row a time that it is met."""
    rows = materialised(rows.withColumnRenamed("work_id", "__by"))
    own = rows.join(work.select(F.col("work_id"), F.col("work_id").alias("__by")), "__by").select("work_id", *rows.columns)
    near = skew.dealt_join(rows, files.join(work.select("work_id"), "work_id", "left_semi").select("work_id", "file").distinct(), ["file"], spread=("row",)).select("work_id", *rows.columns)
    return own.unionByName(near).withColumnRenamed("__by", "by")


def concerned(rows: DataFrame, work: DataFrame, files: DataFrame) -> DataFrame:
    """work_id, n (distinct rows that concern it) and near (those of them that another's work tells), without the pairs of `concerning`.

    A row that is told once, in one file, adds one to each work item of the file, so what such rows add are sums over files: those on its
    files and its own, less its own on its files. Only rows that are told in several ways are paired with the items that see them."""
    kept = rows.select("row", F.col("work_id").alias("by"), "file").distinct()
    told = materialised(kept.withColumn("__ways", F.count("*").over(Window.partitionBy("row"))))
    work = work.select("work_id").distinct()
    files = files.select("work_id", "file").distinct().join(work, "work_id", "left_semi")
    sums = materialised(told.filter("__ways = 1").groupBy("by", "file").agg(F.count("*").alias("k"), F.count_if(F.col("by").isNotNull()).alias("named")))
    here = files.join(sums.groupBy("file").agg(F.sum("k").alias("k"), F.sum("named").alias("named")), "file").select("work_id", F.col("k").alias("n"), F.col("named").alias("near"))
    own = sums.groupBy(F.col("by").alias("work_id")).agg(F.sum("k").alias("n")).join(work, "work_id").withColumn("near", F.lit(0).cast("long"))
    both = sums.join(files.withColumnRenamed("work_id", "by"), ["by", "file"]).groupBy(F.col("by").alias("work_id")).agg((-F.sum("k")).alias("n")).withColumn("near", F.col("n"))
    pairs = seen(told.filter("__ways > 1").select("row", F.col("by").alias("work_id"), "file"), work, files).groupBy("work_id", "row").agg(F.bool_or(F.col("by") != F.col("work_id")).alias("__near"))
    several = pairs.groupBy("work_id").agg(F.count("*").alias("n"), F.count_if("__near").alias("near"))
    return here.unionByName(own).unionByName(both).unionByName(several).groupBy("work_id").agg(F.sum("n").alias("n"), F.sum("near").alias("near"))


def detailed(findings: DataFrame, most: int, *order: Column) -> DataFrame:
    """Findings (reachable: true, false or null) with reach (yes, no or no conclusion), full (only the reachable ones are told in full),
    and of their parts (an array) the first `most` and how many are omitted, in an index's order. No finding is left out."""
    cut = scalars.bounded(F.col("parts"), most)
    told = findings.select("*", F.when(F.col("reachable"), "yes").when(~F.col("reachable"), "no").otherwise("no conclusion").alias("reach"), F.coalesce("reachable", F.lit(False)).alias("full"), cut.alias("__cut"))
    return told.select(*[c for c in findings.columns if c != "parts"], "reach", "full", F.col("__cut.items").alias("parts"), F.col("__cut.omitted").alias("omitted")).orderBy(*order)


def coverage_samples(files: DataFrame, most: int = 15) -> DataFrame:
    """state, file, covered, total, files (of the state) and omitted, of files (file, covered, total; covered null: never opened): the first
    `most` of those that were never opened and of those that were read in part."""
    state = F.when(F.col("covered").isNull(), "never").when(F.col("covered") >= F.col("total"), "full").otherwise("partial")
    told = files.withColumn("state", state)
    n = told.groupBy("state").agg(F.count("*").alias("files"))
    return shown(told.filter("state != 'full'"), ["state"], most, F.col("file")).join(n, "state").select("state", "file", "covered", "total", "files", "omitted")


# --- merges -------------------------------------------------------------------------------------------------------------
def entry_key(text: Column) -> Column:
    """What identifies an entry point: the place `(path:line)` that it names, else its text without case and runs of white space."""
    place = F.regexp_extract(text, r"\(([^()\s]+:[0-9]+)\)", 1)
    return F.coalesce(scalars.nonempty(place), F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))))


def merged_contexts(fragments: DataFrame) -> DataFrame:
    """project, kind, name, value and seq of what fragments (project, seq, kind, value, count) say, merged.

    language: the last count counts. build_system and note: each value once, as it is first met. entry_point: one a place or text,
    the first description. workspace: the first that isn't empty. Each is an aggregate by its key that combines before the shuffle."""
    of = F.when(F.col("kind") == "entry_point", entry_key(F.col("value"))).when(F.col("kind") == "workspace", "").otherwise(F.col("value"))
    rows = fragments.withColumn("__key", of).filter(~((F.col("kind").isin("entry_point", "workspace")) & (F.coalesce(F.trim("value"), F.lit("")) == "")))
    told = rows.groupBy("project", "kind", "__key").agg(F.min_by("value", "seq").alias("value"), F.max_by("count", "seq").alias("count"), F.min("seq").alias("seq"))
    return told.select("project", "kind", "value", F.when(F.col("kind") == "language", F.col("count")).alias("count"), "seq")


def merged_components(rows: DataFrame, fields: list[str], rank: Column) -> tuple[DataFrame, DataFrame]:
    """Components and their sites, of rows (project, component, seq, origin, file, line and `fields`).

    A field comes from the row of the best rank that has one (not null, not blank), the first among equals: better origins upgrade it and
    others fill holes. A site (file and line) is kept once, as it is first met, with nth; rows without a file are no site."""
    known = [F.min_by(F.when(F.trim(F.col(f)) != "", F.col(f)), F.when(F.trim(F.col(f)) != "", F.struct(rank, "seq"))).alias(f) for f in fields]
    parts = rows.groupBy("project", "component").agg(*known, F.count("*").alias("rows"), F.min("seq").alias("seq"))
    sites = rows.filter("file is not null").groupBy("project", "component", "file", "line").agg(F.min("seq").alias("nth"))
    return parts, sites
