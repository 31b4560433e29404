"""Interval unions, complements and coverage, as gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union(df: DataFrame, keys: list[str], start: str, end: str, reach: int = 0) -> DataFrame:
    """Merged intervals of each key. Intervals join while start <= last end + reach: 0 for half-open, 1 for inclusive, more for
    tolerance. An unknown start or end comes last, so it neither parts nor hides the known ones."""
    w = Window.partitionBy(*keys).orderBy(F.col(start).asc_nulls_last(), F.col(end).asc_nulls_last())
    last = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.when(last.isNull() | (F.col(start) > last + reach), 1).otherwise(0))
    islands = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def clamped(df: DataFrame, start: str, end: str, total: str) -> DataFrame:
    return df.withColumn(start, F.greatest(F.col(start), F.lit(1))).withColumn(end, F.least(F.col(end), F.col(total))).filter(F.col(start) <= F.col(end))


def gaps(merged: DataFrame, totals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Inclusive gaps of merged inclusive intervals in 1..total; an unopened key gives (1, null)."""
    w = Window.partitionBy(key).orderBy(start)
    inner = merged.join(totals, key).withColumn("__next", F.lead(start).over(w)).withColumn("__first", F.row_number().over(w) == 1)
    after = inner.select(key, (F.col(end) + 1).alias("gap_start"), F.coalesce(F.col("__next") - 1, F.col("total")).alias("gap_end"))
    head = inner.filter("__first").select(key, F.lit(1).cast(merged.schema[start].dataType).alias("gap_start"), (F.col(start) - 1).alias("gap_end"))
    never = totals.join(merged.select(key).distinct(), key, "left_anti").select(key, F.lit(1).cast(merged.schema[start].dataType).alias("gap_start"), F.lit(None).cast(merged.schema[end].dataType).alias("gap_end"))
    return after.unionByName(head).filter("gap_start <= gap_end").unionByName(never)


def covered(merged: DataFrame, key: str, start: str, end: str) -> DataFrame:
    return merged.groupBy(key).agg(F.sum(F.col(end) - F.col(start) + 1).alias("covered"))
