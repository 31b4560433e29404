"""Joins on keys that a few values dominate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups of keys by hash, which are counted before keys are.
GROUPS = 1 << 16


def salted_join(rows: DataFrame, side: DataFrame, on: list[str], n: str, total: int, how: str = "inner", spread: tuple[str, ...] = (), counts: DataFrame | None = None) -> DataFrame:
    """`rows` joined to `side`, which has one row a key and in column `n` (left out of the result) how many of the `total` rows have it.

    Keys with over a thousandth of the rows (256 at least), of which there are a thousand at most, are dealt to slices by
    the row's partition and its columns `spread`, which are the same when a task runs again, so no key lands in one task;
    only those keys are broadcast. They are taken from `counts` (keys and n) where `side` is dear to make twice."""
    share = max(256, total // 1000)
    slices = F.ceil(F.col(n) / share).cast("int")
    hot = (side if counts is None else counts).filter(F.col(n) > share).select(*on, slices.alias("__slices"))
    dealt = rows.join(F.broadcast(hot), on, "left")
    dealt = dealt.withColumn("__salt", F.when(F.col("__slices").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.spark_partition_id(), *map(F.col, spread)), F.col("__slices")).cast("int"))).drop("__slices")
    spread = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.when(F.col(n) > share, slices).otherwise(1)) - 1))).drop(n)
    return dealt.join(spread, [*on, "__salt"], how).drop("__salt")


def dealt(rows: DataFrame, *on: str) -> DataFrame:
    """`rows` by the keys `on` in as many partitions as shuffles have, by number, so that small files of many rows and merged partitions
    don't bring them together in a few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on)


def keyed_join(rows: DataFrame, side: DataFrame, on: list[str], how: str = "left", spread: tuple[str, ...] = ()) -> DataFrame:
    """`rows` joined to `side`, which has one row a key: a plain join unless a key has over a thousandth of the rows (256 at least),
    else `salted_join`. `rows` are a table or a written one, as they are counted first: by groups of keys, of which few rows a task move; where no
    group is large no key is."""
    groups = rows.groupBy(F.pmod(F.xxhash64(*on), F.lit(GROUPS)).alias("__group")).agg(F.count("*").alias("__n"))
    told = groups.agg(F.sum("__n").alias("total"), F.max("__n").alias("most")).first()
    if told["total"] is None or told["most"] <= max(256, told["total"] // 1000):
        return rows.join(side, on, how)
    counts = rows.groupBy(*on).agg(F.count("*").alias("__n"))
    if counts.agg(F.max("__n").alias("most")).first()["most"] <= max(256, told["total"] // 1000):
        return rows.join(side, on, how)
    hot = counts.filter(F.col("__n") > max(256, told["total"] // 1000))
    side = side.join(F.broadcast(hot), on, "left").withColumn("__n", F.coalesce("__n", F.lit(1)))
    return salted_join(rows, side, on, "__n", told["total"], how, spread, counts=hot)


def dealt_join(rows: DataFrame, others: DataFrame, on: list[str], most_broadcast: int = 10_000, spread: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of `rows` and `others` of equal keys, where both may have many rows of a key: `others` are broadcast if their count is
    within `most_broadcast`; else keys with many rows are dealt to slices and `others` of these keys stand in each."""
    if others.limit(most_broadcast + 1).count() <= most_broadcast:
        return rows.join(F.broadcast(others), on)
    counts = rows.groupBy(*on).agg(F.count("*").alias("__n"))
    total = rows.count()
    share = max(256, total // 1000)
    hot = F.broadcast(counts.filter(F.col("__n") > share).select(*on, F.ceil(F.col("__n") / share).cast("int").alias("__slices")))  # a thousand keys at most
    salt = F.when(F.col("__slices").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.spark_partition_id(), *map(F.col, spread)), F.col("__slices")).cast("int"))
    dealt = rows.join(hot, on, "left").withColumn("__salt", salt).drop("__slices")
    copied = others.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__slices", F.lit(1)) - 1))).drop("__slices")
    return dealt.join(copied, [*on, "__salt"]).drop("__salt")
