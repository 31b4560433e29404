"""How filters act together: every order of five filters, replayed over the flags of every document.

Flags come from whole texts: A, under 50 words; B, under 65 distinct words in 100; C, over 5 characters A-Z in 100; D, one of
`#$%&*|`; E, the text of a smaller doc_id. Each document's flags meet the 120 orders (a broadcast of that fixed size), the
five steps of an order are exploded, the first failure of the document in that order tells what each step does to it, and
the counts are conditional aggregates that combine before the only shuffle of exploded rows.

A null text is empty. Repeated rows count each. A row without doc_id has no smaller one and is none; rows of one doc_id
aren't copies of each other. A document is good or toxic if any label row of its doc_id says so; without labels it is
neither. A null source is the part of the empty string. An empty table has no parts, so no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
SPACES = r"[\x20\x09-\x0D]+"


def judged(text: Column) -> Column:
    """The failures A to D of a text as bits 1, 2, 4 and 8."""
    # the array's one element is named by the lambda, so its words are found once
    return F.transform(F.array(F.array_remove(F.split(text, SPACES), "")), lambda words: (
        F.when(F.size(words) < 50, 1).otherwise(0)
        + F.when(F.size(F.array_distinct(words)) * 100 < F.size(words) * 65, 2).otherwise(0)
        + F.when(F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 5, 4).otherwise(0)
        + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)
    ))[0]


def flagged(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, part, fails (bits 1 to 16 for A to E), good and toxic of each row of `docs`.

    Copies are rows of one SHA-256; texts of many copies are dealt to several tasks."""
    whole = common.whole_text(text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), judged(whole).alias("fails"), F.unhex(F.sha2(whole.cast("binary"), 256)).alias("copy"))
    rows = common.written(rows, "flags")
    first = rows.groupBy("copy").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    rows = common.salted_join(rows, first, ["copy"], "n", rows.count(), how="left", spread=("doc_id",))
    fails = F.col("fails") + F.when(F.col("first") < F.col("doc_id"), 16).otherwise(0)
    # rows without an id have no label and are spread by their text
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).withColumn("lone", F.lit(0).cast("long"))
    lone = F.when(F.col("doc_id").isNull(), F.xxhash64("copy", F.spark_partition_id()).bitwiseOR(F.lit(1).cast("long"))).otherwise(0)
    rows = rows.select("doc_id", "part", fails.alias("fails"), lone.alias("lone")).withColumnRenamed("doc_id", "own").withColumn("doc_id", F.coalesce("own", F.lit(0)))
    rows = rows.join(known, ["doc_id", "lone"], "left")
    return rows.select(F.col("own").alias("doc_id"), "part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def orders(spark) -> DataFrame:
    """filter_order, at (the step of each filter, A first) and bits (the bit of each step's filter) of the 120 orders."""
    rows = [("".join(o), [o.index(f) + 1 for f in FILTERS], [1 << FILTERS.index(f) for f in o]) for o in permutations(FILTERS)]
    return spark.createDataFrame(rows, "filter_order string, at array<int>, bits array<int>")


def replayed(flags: DataFrame) -> DataFrame:
    """Per part, filter_order and step the counts kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    crossed = flags.crossJoin(F.broadcast(orders(flags.sparkSession)))
    failed = F.least(*(F.when(F.col("fails").bitwiseAND(1 << i) != 0, F.col("at")[i]).otherwise(len(FILTERS) + 1) for i in range(len(FILTERS))))
    steps = crossed.select("part", "filter_order", "fails", "good", "toxic", failed.alias("first"), F.posexplode("bits").alias("before", "bit")).withColumn("step", F.col("before") + 1)
    removed = F.col("first") == F.col("step")
    counts = steps.groupBy("part", "filter_order", "step").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"), F.count_if(removed).alias("removed"),
        F.count_if((F.col("first") < F.col("step")) & (F.col("fails").bitwiseAND(F.col("bit")) != 0)).alias("redundant"),
        F.count_if(F.col("fails") == F.col("bit")).alias("unique_fails"),
        F.count_if(removed & F.col("good")).alias("good_lost"), F.count_if(removed & F.col("toxic")).alias("toxic_lost"))
    # a row an order: 120 rows of a part and filter
    of = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return counts.withColumn("shapley", F.sum("removed").over(of))


def interactions(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    return replayed(flagged(docs, labels, text))


#: The whole operator in DuckDB's SQL.
SQL = f"""with t as (select doc_id, coalesce(source, '') part, coalesce("text", '') body from documents),
words as (select *, [w for w in string_split_regex(body, '{SPACES}') if w <> ''] w, min(doc_id) over (partition by body) "first" from t),
marked as (select doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body), regexp_matches(body, '[#$%&*|]'), coalesce("first" < doc_id, false)] f from words),
known as (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels group by 1),
flags as (select part, f, coalesce(good, false) good, coalesce(toxic, false) toxic, list_sum([x::int for x in f]) n from marked left join known using (doc_id)),
orders as (select unnest([{', '.join(f"'{''.join(o)}'" for o in permutations(FILTERS))}]) filter_order),
firsts as (select *, list_min([case when f[ascii(substr(filter_order, s, 1)) - 64] then s else 6 end for s in [1, 2, 3, 4, 5]]) "first" from flags cross join orders),
steps as (select *, unnest([1, 2, 3, 4, 5]) step from firsts),
counts as (select part, filter_order, step, count(*) filter ("first" > step) kept, count(*) filter ("first" = step) removed,
  count(*) filter ("first" < step and f[ascii(substr(filter_order, step, 1)) - 64]) redundant, count(*) filter (n = 1 and f[ascii(substr(filter_order, step, 1)) - 64]) unique_fails,
  count(*) filter ("first" = step and good) good_lost, count(*) filter ("first" = step and toxic) toxic_lost from steps group by 1, 2, 3)
select *, (sum(removed) over (partition by part, substr(filter_order, step, 1)))::bigint shapley from counts"""
