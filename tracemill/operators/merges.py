"""Findings of one flow as one finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from . import graph, skew
from .store import materialised


def anchored(source: Column) -> Column:
    """Whether a flow starts at a parameter of a named function, not at a pattern of calls: `name(parameter)` without a dot before the
    bracket."""
    bare = F.trim(source)
    return F.coalesce(F.endswith(bare, F.lit(")")) & F.contains(bare, F.lit("(")) & ~F.contains(F.element_at(F.split(bare, r"\("), 1), F.lit(".")), F.lit(False))


def step_place(step: Column) -> Column:
    """struct<file, line> of a step `file:line node`; null where it doesn't begin so."""
    head = F.element_at(F.split(step, " "), 1)
    line = F.regexp_extract(head, "^.+:([0-9]+)$", 1)
    return F.when(line != "", F.struct(F.regexp_extract(head, "^(.+):[0-9]+$", 1).alias("file"), line.cast("int").alias("line")))


def by_flow(findings: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings after those of one flow are merged, and the places of merged ones.

    findings: id, at (a number that orders them), file, line, severity, derived, source and other columns; steps: id, step. Two
    findings with derived flows that are anchored at a parameter are of one flow if their flows share a place, their own included,
    directly or over others. The first of them stands for all, with the worst severity, members (how many) and place behind all that
    weren't merged. The second table has id (of the first), nth, file and line: its own place, then the others' as they
    are first met. Both are tables of rows: a flow that most findings share isn't collected."""
    flows = materialised(findings.filter(F.col("derived") & anchored(F.col("source"))).select("id", "at", "file", "line", "severity"))
    own = flows.select("id", "at", F.struct("file", F.col("line").cast("int").alias("line")).alias("p"))
    touched = own.unionByName(steps.select("id", step_place(F.col("step")).alias("p")).filter("p is not null").join(flows.select("id", "at"), "id")).distinct()
    links = graph.stars(materialised(touched), "p", "at")
    roots = graph.components(links)  # by `at`, so the root is the first
    ranks = F.coalesce(F.array_position(F.array(*map(F.lit, fixed.FINAL_SEVERITIES)), F.col("severity")), F.lit(0))
    held = materialised(flows.join(roots.withColumnRenamed("node", "at"), "at").withColumn("rank", F.greatest(ranks, F.lit(1))))
    sums = held.groupBy("root").agg(F.count("*").alias("members"), F.max_by("severity", F.struct("rank", -F.col("at"))).alias("worst"))
    inside = held.select("at", "root")
    told = findings.join(inside, "at", "left").filter(F.col("root").isNull() | (F.col("root") == F.col("at"))).join(sums, "root", "left")
    merged = F.col("root").isNotNull()
    columns = [F.when(merged, F.col("worst")).otherwise(F.col("severity")).alias("severity") if c == "severity" else F.col(c) for c in findings.columns]
    whole = told.select(*columns, F.coalesce("members", F.lit(1)).alias("members"), F.struct(merged.cast("int").alias("merged"), F.col("at").alias("at")).alias("place"))
    places = held.groupBy("root", "file", "line").agg(F.min("at").alias("first"))
    ids = flows.select(F.col("at").alias("root"), "id")
    return whole, skew.keyed_join(materialised(places), ids, ["root"], "inner", ("first",)).select("id", F.col("first").alias("nth"), "file", "line")


def in_order(merged: DataFrame, order: str = "place") -> DataFrame:
    """A dense number instead of the place of `by_flow`, for a list that a person reads."""
    from .rows import ordinal

    return ordinal(merged, "nth", F.col(order)).drop(order)


def first_places(places: DataFrame, most: int) -> DataFrame:
    """The first `most` places of each finding and how many more there are."""
    n = places.groupBy("id").agg(F.greatest(F.count("*") - most, F.lit(0)).alias("omitted"))
    return places.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy("nth"))).filter(F.col("__n") <= most).drop("__n").join(n, "id")
