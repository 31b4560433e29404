"""Latest-wins, dedupe, top-k, set and merge operators."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order (null is a key)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def top_per(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def latest(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Each key with the values of its last row; sums up before the shuffle."""
    return df.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in columns])


def ordinal(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """A dense 0-based position in a total order without moving all rows to one task: ranges are sorted, counted, and each
    range's start is added to the position inside it. The table of ranges has as many rows as partitions.

    Ranges are written once, so positions and counts come from the same split."""
    from tracemill.operators.store import materialised

    parts = materialised(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    counts = parts.groupBy("__range").agg(F.count("*").alias("__count"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__count")
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return parts.withColumn("__inside", inside).join(F.broadcast(before), "__range").withColumn(name, F.col("__inside") + F.col("__before")).drop("__range", "__inside", "__before")


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The sum of `value` over the rows of a key so far, this one included, in order. Rows are cut into ranges of (key, order), so a
    key of any size is dealt to several tasks; what a key had in the ranges before is added. Ranges are written once. Rows of a key must
    differ in `order`."""
    from tracemill.operators.store import materialised

    parts = materialised(df.withColumn(name, value.cast("long")).repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()))
    before = F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    # a row a key and range; a key has as many as it has ranges
    carried = parts.groupBy("__range", *keys).agg(F.sum(name).alias("__sum")).withColumn("__before", before).filter("__before != 0").drop("__sum")
    inside = F.sum(name).over(Window.partitionBy("__range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("p.__range") == F.col("c.__range")
    for k in keys:
        same = same & F.col(f"p.{k}").eqNullSafe(F.col(f"c.{k}"))
    summed = parts.withColumn("__inside", inside)
    return summed.alias("p").join(carried.alias("c"), same, "left").select(*[F.col(f"p.{c}") for c in df.columns if c != name], (F.col("p.__inside") + F.coalesce("c.__before", F.lit(0))).alias(name))


def chunked(df: DataFrame, size: int, *order: Column) -> DataFrame:
    return ordinal(df, "__at", *order).withColumn("chunk", F.floor(F.col("__at") / size).cast("long")).drop("__at")


def page(df: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    """Rows of one page with the total before paging."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # the total is one row


def insert_absent(old: DataFrame, new: DataFrame, key: str, *order: Column) -> DataFrame:
    """`old` and the first row of each trimmed, non-empty key of `new` that it lacks."""
    rows = first_by(new.withColumn(key, F.trim(key)).filter(F.col(key) != ""), [key], *order)
    return old.unionByName(rows.join(old.select(key), key, "left_anti").select(*old.columns))


def fill_absent(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of `first`, and rows of `second` whose key it lacks."""
    return first.withColumn("origin", F.lit(0)).unionByName(second.join(first.select(key), key, "left_anti").withColumn("origin", F.lit(1)))


def override(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer merge by key; right values win where they aren't null."""
    l, r = left.alias("l"), right.alias("r")
    names = [c for c in dict.fromkeys([*left.columns, *right.columns]) if c != key]
    both = l.join(r, F.col(f"l.{key}") == F.col(f"r.{key}"), "full_outer")

    def value(c: str) -> Column:
        sides = [F.col(f"{s}.{c}") for s, d in (("r", right), ("l", left)) if c in d.columns]
        return F.coalesce(*(sides if c in columns else reversed(sides))).alias(c)

    return both.select(F.coalesce(F.col(f"l.{key}"), F.col(f"r.{key}")).alias(key), *[value(c) for c in names])


def id_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Each distinct key with the side that has it: left, right or both."""
    a, b = left.select(key).distinct().withColumn("a", F.lit(1)), right.select(key).distinct().withColumn("b", F.lit(1))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("a").isNull(), "right").when(F.col("b").isNull(), "left").otherwise("both").alias("side"))


def epochs(df: DataFrame, key: str, order: str, starts: Column, name: str = "epoch") -> DataFrame:
    """The number of start rows so far within the key, in order; 0 before the first."""
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(Window.partitionBy(key).orderBy(order)))


def greedy_fit(df: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows of each key that fit the budget in order: one that is too big is skipped and later ones may still fit.

    Rows of a key pass one task in order, as a stream that holds a sum. Those larger than the whole budget can't fit and don't move."""
    kinds = dict(df.dtypes)
    near = df.select(key, order, size).filter(F.col(size) <= budget).repartition(key).sortWithinPartitions(key, order, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = object(), 0
        for batch in batches:
            kept = []
            for k, n in zip(batch[0].to_pylist(), batch[2].to_pylist(), strict=True):
                if k != now:
                    now, used = k, 0
                kept.append(used + n <= budget)
                used += n if kept[-1] else 0
            yield batch.filter(pa.array(kept, "bool"))

    return near.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in (key, order, size)))


def dropped_to_budget(df: DataFrame, size: str, budget: Column, order: list[Column], keys: list[str] | None = None) -> DataFrame:
    """Column dropped: rows go in order until what is left is within the budget; `fixed` rows never go."""
    w = Window.partitionBy(*(keys or []))
    total = F.sum(size).over(w)
    before = F.coalesce(F.sum(F.when(F.col("fixed"), 0).otherwise(F.col(size))).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("dropped", ~F.col("fixed") & (before < total - budget))


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)
