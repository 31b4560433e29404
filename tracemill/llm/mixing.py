"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each source's target is so many copies of each of its documents; the whole part is taken of all, the fraction is a
probability. Documents meet in pairs: size-weighted mass moves between two fractions, in a random direction that leaves
their expectations unchanged, until one is 0 or 1; the other goes on to the next pair. Small groups of documents of a
source are worked off in array expressions, each leaving at most one fraction, and these residuals go up a tree of
groups. All moves keep the sum of size times copies. The last fraction of a source becomes 1 with just this probability;
documents of some small groups, in random order, are then turned over to bring the source's words back near the target. As many
words are turned out, in expectation, as in, so a document's chance stays its fraction. Where the last residual is a large part of a
small source, and one way can't be made up for, the other is taken: there the words come before the chances (figures are in the
README).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

GROUP = 32
#: Groups of a source whose documents make up for the last residual.
EVENING = 16
#: Once a document is too large for what is left, those are turned that are at least this part of it.
CLOSE = 2
ITEM = "struct<size:bigint,doc_id:bigint,nth:int,p:double>"
TINY = 1e-9
WORD = r"[^\x20\x09-\x0D]+"
MOST_BROADCAST = 50_000  # sources; a row of the table of sources is under 1 kB


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def sized(docs: DataFrame, text: str = "text") -> Column:
    return F.regexp_count(common.whole_text(text), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, n (documents with words), source_size and target of each source of `sizes` (source, size).

    Sources by code point, null last, take the weights in turn and share the total size; no target exceeds `most` times
    its source's size, and what is left over is shared among the others by weight. Sorted by most * size / weight, the
    sources that are capped come first, and the level of the rest is the greatest of (what the ones before leave) /
    (weights from here on)."""
    each = sizes.groupBy("source").agg(F.count_if(F.col("size") > 0).alias("n"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    each = each.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")).cast("double"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    each = each.withColumn("level", left / F.sum("weight").over(onward))
    level = F.max("level").over(every)
    return each.select("source", "n", "source_size", F.least(most * F.col("source_size").cast("double"), F.col("weight") * level).alias("target"))


def settled(p: Column) -> Column:
    return (p < TINY) | (p > 1 - TINY)


def uniform(*of: Column) -> Column:
    """A number from 0 to 1 told by the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / F.lit(float(1 << 53))


def pairwise(items: Column, seed: int) -> Column:
    """items: array of ITEM. A struct<done, rest>: items with p 0 or 1, and at most one with a fraction."""
    item = ITEM
    none = F.lit(None).cast(item)

    def made(x: Column, p: Column) -> Column:
        return F.struct(x["size"].alias("size"), x["doc_id"].alias("doc_id"), x["nth"].alias("nth"), F.when(p < TINY, 0.0).when(p > 1 - TINY, 1.0).otherwise(p).alias("p"))

    def met(a: Column, b: Column) -> Column:
        rate = b["size"] / a["size"]
        up, down = F.least(1 - a["p"], b["p"] * rate), F.least(a["p"], (1 - b["p"]) * rate)
        chance = uniform(F.lit(seed), a["doc_id"], a["size"], a["nth"], b["doc_id"], b["size"], b["nth"])
        move = let(F.struct(up.alias("up"), down.alias("down")), lambda m: F.when(chance * (m["up"] + m["down"]) < m["down"], m["up"]).otherwise(-m["down"]))
        return let(move, lambda d: F.struct(made(a, a["p"] + d).alias("a"), made(b, b["p"] - d * a["size"] / b["size"]).alias("b")))

    def step(state: Column, x: Column) -> Column:
        both = let(met(state["rest"], x), lambda m: F.struct(
            F.concat(state["done"], F.filter(F.array(m["a"], m["b"]), lambda y: settled(y["p"]))).alias("done"),
            F.get(F.filter(F.array(m["a"], m["b"]), lambda y: ~settled(y["p"])), F.lit(0)).alias("rest"),
        ))
        return F.when(state["rest"].isNull(), F.struct(state["done"].alias("done"), x.alias("rest"))).otherwise(both)

    return F.aggregate(items, F.struct(F.array().cast(f"array<{item}>").alias("done"), none.alias("rest")), step)


def rounded(items: DataFrame, largest: int, seed: int) -> DataFrame:
    """items: source, n, doc_id, size, nth (among equal rows), p (a fraction). The same with p 0 or 1, by a reduction tree over
    groups of a source. Groups of about GROUP come from a hash of an item, so repeated rows are spread like others."""
    group = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"), F.col("nth")), F.greatest(F.lit(1), F.ceil(F.col("n") / GROUP)))
    now = items.select("source", group.cast("long").alias("group"), F.struct("size", "doc_id", "nth", "p").alias("item"))
    done, groups, level = [], -(-largest // GROUP), 0
    while True:
        # the largest first: what is left over at the end is then seldom a long document
        order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("item.size")).alias("s"), F.xxhash64("item").alias("h"), "item"))), lambda x: x["item"])
        held = now.groupBy("source", "group").agg(order.alias("items"))
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("items") - 1) / 64).cast("int")), lambda i: pairwise(F.slice("items", i * 64 + 1, F.lit(64)), seed + level))
        worked = held.select("source", "group", cut.alias("cut"))
        again = let(F.filter(F.transform("cut", lambda c: c["rest"]), lambda r: r.isNotNull()), lambda rest: pairwise(rest, seed + level + 100))
        worked = worked.select("source", "group", F.flatten(F.transform("cut", lambda c: c["done"])).alias("done"), again.alias("top"))
        table = common.written(worked.select("source", "group", F.concat("done", "top.done").alias("done"), F.col("top.rest").alias("rest")), f"mix-{level}")
        done.append(table)
        now = table.filter("rest is not null").select("source", F.floor(F.col("group") / GROUP).alias("group"), F.col("rest").alias("item"))
        if groups <= 1:
            break
        groups, level = -(-groups // GROUP), level + 1
    # one fraction a source is left: it is drawn, and documents of the source's first groups make up for what that adds or takes
    size, p = F.col("item.size"), F.col("item.p")
    drawn = uniform(F.lit(seed), F.lit("last"), F.col("item")) < p
    last = common.written(now.select("source", "item", drawn.alias("in"), (size * (1 - p)).alias("over"), (size * p).alias("under")), "mix-rest")
    some = done[0].filter(F.col("group") < EVENING).groupBy("source").agg(F.flatten(F.collect_list("done")).alias("done"))  # a bounded number of small groups
    both = some.join(last.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")), "full_outer")
    both = both.select(F.coalesce("source", "__source").alias("source"), F.coalesce("done", F.array().cast(f"array<{ITEM}>")).alias("done"), "item", "in", "over", "under")

    def held(value: float) -> Column:
        return F.aggregate("done", F.lit(0).cast("long"), lambda n, x: n + F.when(x["p"] == value, x["size"]).otherwise(0))

    # where too few words are in to be turned out, or out to be turned in, the other way is taken if it has enough
    both = both.withColumn("ins", held(1.0)).withColumn("outs", held(0.0))
    short = F.when(F.col("in"), (F.col("ins") < F.col("over")) & (F.col("outs") >= F.col("under"))).otherwise((F.col("outs") < F.col("under")) & (F.col("ins") >= F.col("over")))
    both = both.withColumn("in", F.col("in") != short)
    excess = F.when(F.col("in"), F.col("over")).otherwise(-F.col("under"))
    item = F.struct(size.alias("size"), F.col("item.doc_id").alias("doc_id"), F.col("item.nth").alias("nth"), F.col("in").cast("double").alias("p"))
    own = F.when(F.col("item").isNotNull(), F.array(item)).otherwise(F.array().cast(f"array<{ITEM}>"))
    every = both.select("source", F.explode(F.concat(evenly(F.col("done"), F.coalesce(excess, F.lit(0.0))), own)).alias("item"))
    for k, table in enumerate(done):
        every = every.unionByName((table if k else table.filter(F.col("group") >= EVENING)).select("source", F.explode("done").alias("item")))
    return every.select("source", "item.size", "item.doc_id", "item.p")


def evenly(items: Column, excess: Column) -> Column:
    """items with p 0 or 1; in the order of a hash they are turned over until the next one is more than what is left of the excess, and then
    those that are at least a part of what is left. (Any smaller one would turn small documents more often than others.)"""
    order = F.transform(F.array_sort(F.transform(items, lambda x: F.struct(F.xxhash64(x["doc_id"], x["nth"], x["size"]).alias("h"), x.alias("x")))), lambda y: y["x"])

    def step(state: Column, x: Column) -> Column:
        sign = 2 * x["p"] - 1
        due = sign * state["excess"] > 0
        turn = due & (x["size"] <= F.abs(state["excess"])) & (~state["closing"] | (CLOSE * x["size"] >= F.abs(state["excess"])))
        new = F.struct(x["size"].alias("size"), x["doc_id"].alias("doc_id"), x["nth"].alias("nth"), F.when(turn, 1 - x["p"]).otherwise(x["p"]).alias("p"))
        left = F.when(turn, state["excess"] - sign * x["size"]).otherwise(state["excess"])
        closing = state["closing"] | (due & (x["size"] > F.abs(state["excess"])))
        return F.struct(F.concat(state["out"], F.array(new)).alias("out"), left.alias("excess"), closing.alias("closing"))

    return F.aggregate(order, F.struct(F.array().cast(f"array<{ITEM}>").alias("out"), excess.alias("excess"), F.lit(False).alias("closing")), step)["out"]


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 20_251, text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, source, size (words), source_size, target (of its source), copies and taken (words).

    A null text has size 0; a document without words is taken once and adds nothing; the null source is a source of its
    own. copies is at most `most`. Equal inputs give equal results. An empty table gives no rows."""
    each = common.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), sized(docs, text).alias("size")), "sizes")
    sources = common.written(targets(each, weights, most), "targets")
    known = sources.agg(F.count("*").alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("largest")).first()
    side = F.broadcast(sources) if known["rows"] <= MOST_BROADCAST else sources
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    whole = F.floor(F.col("rate") + TINY)
    shares = side.select(F.col("source").alias("__source"), "n", "source_size", "target", rate.alias("rate")).withColumn("whole", whole).withColumn("part", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    alike = each.groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows"))  # equal rows meet before the shuffle
    joined = alike.join(shares, F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("rows")
    fractional = (F.col("size") > 0) & ~settled(F.col("part"))
    parts = rounded(joined.filter(fractional).select("source", "n", "doc_id", "size", "nth", F.col("part").alias("p")), known["largest"], seed)
    back = parts.join(shares, F.col("source").eqNullSafe(F.col("__source"))).select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("p")).cast("long").alias("copies"))
    plain = joined.filter(~fractional).select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("whole")).otherwise(1).cast("long").alias("copies"))
    return back.unionByName(plain).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """`docs` as the mix takes them: rows repeated by their copies, rows with none left out, columns as before.

    Rows meet their copies by doc_id, size and source. Where several rows have these and differ in copies, places among
    them tell rows apart; equal rows may stand for each other."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kinds = dict(docs.dtypes)
    order = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not kinds[c].startswith(("map", "variant", "void"))])

    def key(doc_id: Column, size: Column, source: Column) -> Column:
        return F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("none")), F.lit(":"), size.cast("string"), F.coalesce(F.concat(F.lit(":"), source.cast("string")), F.lit("")))

    taken = common.written(mix(docs, **how).select(key(F.col("doc_id"), F.col("size"), F.col("source")).alias("__key"), "copies"), "taken")
    keys = taken.groupBy("__key").agg(F.count("*").alias("n"), F.min("copies").alias("__copies"), (F.min("copies") != F.max("copies")).alias("__differ"))
    own = common.salted_join(docs.withColumn("__key", key(F.col("doc_id"), sized(docs), F.col("source"))), keys, ["__key"], "n", taken.count())
    place = Window.partitionBy("__key")
    differ = taken.join(keys.filter("__differ").select("__key"), "__key", "left_semi").withColumn("__place", F.row_number().over(place.orderBy("copies")))
    placed = own.filter("__differ").withColumn("__place", F.row_number().over(place.orderBy(order))).drop("__copies").join(differ.withColumnRenamed("copies", "__copies"), ["__key", "__place"])
    every = own.filter("not __differ").select(*columns, "__copies").unionByName(placed.select(*columns, "__copies"))
    return every.filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*columns)
