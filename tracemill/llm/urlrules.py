"""URL filters: host and path rules, and a tree of path templates per host, in DataFrame operations only.

Paths become templates: segments that are numbers, dates, hashes or long mixed names turn into wildcards by their shape,
and so do the rare children of a node with many. Then branches under one parent merge, at every level, if their subtrees
are alike: they have the same main template below them, the distribution of templates below is near to that of the
branches with this main template together, and their labelled shares don't differ significantly. A branch without labels
joins by its templates alone, so that labels reach it.

A node's purity is the share of its labelled pages that are bad, smoothed towards what its parent expects of a child: the
mean of the bad shares of the parent's labelled children (their unlabelled pages count as the prior), smoothed in turn towards the
grandparent's, up through the domains above a host to a prior. Templates at or above a threshold are rejected.

Trees are rows of (node, parent) hashes, so paths of any depth are worked off at all levels at once; a pass is repeated
until it changes nothing. Each pass that changes something leaves fewer segments or fewer branches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first :// up to / ? # or the end, A-Z lower-cased; the path from there up to ? # or the end. Both are
    empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(raw, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (host and path prefix) that fits the host or a parent domain, and its verdict; null if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, pattern in sorted(rules, key=lambda r: len(r[1])):
        at, slash, rest = pattern.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, pattern).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def shape(segment: Column) -> Column:
    """A segment with what varies by its shape alone as *."""
    stem, end = F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z]{1,5})?$", 2)
    varies = stem.rlike(r"^[0-9]+$|^[0-9a-fA-F]{8,}$|^[0-9a-fA-F-]{32,}$|^[0-9]{1,4}([-_.][0-9]{1,4})+$") | (stem.rlike("[0-9]") & (F.length(stem) >= 8)) | (F.length(stem) >= 32)
    return F.when(varies, F.concat(F.lit("*"), end)).otherwise(segment)


def shapes(path: Column) -> Column:
    """The segments of a path as shapes."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), shape)


def chained(items: Column, first: Column) -> Column:
    """Hashes of all prefixes of an array, `first` and then one an item."""
    return F.aggregate(items, F.array(first), lambda told, x: F.concat(told, F.array(F.xxhash64(F.element_at(told, -1), x))))


def branches(now: DataFrame) -> DataFrame:
    """One row for each segment of each template: leaf (hash of the whole template), at (from 0), parent and node (hashes),
    child (the segment), below (hash of the segments after it), n, labelled, bad."""
    nodes = chained(F.col("template"), F.xxhash64("host"))
    rest = chained(F.reverse("template"), F.xxhash64(F.lit("")))
    deep = now.filter(F.size("template") > 0).select("n", "labelled", "bad", "template", nodes.alias("nodes"), F.reverse(rest).alias("rest"))
    at = F.posexplode("template").alias("at", "child")
    each = deep.select("n", "labelled", "bad", "nodes", "rest", at)
    return each.select(F.element_at("nodes", -1).alias("leaf"), "at", F.get("nodes", F.col("at")).alias("parent"), F.get("nodes", F.col("at") + 1).alias("node"), "child", F.get("rest", F.col("at") + 1).alias("below"), "n", "labelled", "bad")


def renamed(now: DataFrame, each: DataFrame, names: DataFrame) -> DataFrame:
    """`now` with the segments of the nodes in `names` (node, name) renamed."""
    changes = each.select("leaf", "at", "node").distinct().join(names, "node").groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct("at", "name"))).alias("names"))
    keyed = now.withColumn("leaf", F.element_at(chained(F.col("template"), F.xxhash64("host")), -1))
    told = keyed.join(changes, "leaf", "left")
    return common.written(told.withColumn("template", F.when(F.col("names").isNull(), F.col("template")).otherwise(F.transform("template", lambda x, i: F.coalesce(F.try_element_at("names", i), x)))).drop("leaf", "names"), "paths")


def wildcards(now: DataFrame, fanout: int) -> DataFrame:
    """A child of a node with more than `fanout` children becomes a wildcard if it has under 1/fanout of the node's pages."""
    while True:
        each = common.written(branches(now), "branches")
        of = each.groupBy("parent", "node", "child").agg(F.sum("n").alias("of"))
        parent = of.groupBy("parent").agg(F.count("*").alias("children"), F.sum("of").alias("all")).filter(F.col("children") > fanout)
        rare = of.filter("child != '*'").join(parent, "parent").filter(F.col("of") * fanout < F.col("all")).select("node", F.lit("*").alias("name"))
        rare = common.written(rare, "rare")
        if rare.isEmpty():
            common.dropped(each, rare)
            return now
        now = renamed(now, each, rare)
        common.dropped(each, rare)


def merges(now: DataFrame, alike: float, distance: float) -> DataFrame:
    """Branches of one parent with the same main template below merge if the distribution of what is below is within `distance` (total
    variation, and one standard error more) of theirs together and the labelled share within `alike` standard errors."""
    end = F.xxhash64(F.lit(""))
    while True:
        each = common.written(branches(now), "branches")
        parts = each.groupBy("parent", "node", "child", "below").agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
        whole = parts.groupBy("parent", "node", "child").agg(F.sum("n").alias("all"), F.sum("l").alias("l"), F.sum("b").alias("b"), F.max_by("below", F.struct("n", "below")).alias("main")).filter(F.col("main") != end)
        pool = whole.groupBy("parent", "main").agg(F.count("*").alias("members"), F.sum("all").alias("pall"), F.sum("l").alias("pl"), F.sum("b").alias("pb")).filter("members > 1")
        known = common.written(whole.join(pool, ["parent", "main"]), "siblings")
        if known.isEmpty():
            return now
        own = parts.select("node", "below", "n").join(known.select("node", "parent", "main", "all", "pall"), "node")
        shared = own.groupBy("parent", "main", "below").agg(F.sum("n").alias("pn"))
        far = own.join(shared, ["parent", "main", "below"]).withColumn("p", F.col("pn") / F.col("pall")).groupBy("node").agg(((F.sum(F.abs(F.col("n") / F.col("all") - F.col("p"))) + 1 - F.sum("p")) / 2).alias("far"))
        share = F.try_divide("pb", "pl")
        error = F.sqrt(F.try_divide(share * (1 - share), F.col("l")) + 1e-12)
        like = (F.col("far") <= distance + 1 / F.sqrt("all")) & F.coalesce(F.abs(F.try_divide("b", "l") - share) <= alike * error + 1e-6, F.lit(True))
        close = known.join(far, "node").filter(like).select("parent", "main", "node", "child")
        group = close.groupBy("parent", "main").agg(F.count("*").alias("n"), F.concat(F.lit("~"), F.regexp_replace(F.min("child"), "^~", "")).alias("name")).filter("n > 1")
        names = common.written(close.join(group.drop("n"), ["parent", "main"]).select("node", "name"), "merged")
        if names.isEmpty():
            common.dropped(each, known, names)
            return now
        now = renamed(now, each, names)
        common.dropped(each, known, names)


def domains(host: Column) -> Column:
    """The domains above a host, the shortest first; of two labels at least, and none above an address."""
    parts = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 2), lambda i: F.array_join(F.slice(parts, -(i + 1), i + 1), "."))
    return F.when((F.size(parts) > 2) & ~host.rlike(r"^[0-9.]*$"), above).otherwise(F.array().cast("array<string>"))


def purities(now: DataFrame, prior: float, strength: float) -> DataFrame:
    """host, shape, template and purity."""
    line = F.concat(F.transform(domains(F.col("host")), lambda d: F.xxhash64(F.lit("above"), d)), chained(F.col("template"), F.xxhash64("host")))
    lines = common.written(now.withColumn("line", line), "lines")
    last = F.element_at("line", -1)
    # counts of every node of the tree, each template counted once
    each = lines.groupBy(last.alias("leaf")).agg(F.first("line").alias("line"), F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    steps = each.select("n", "l", "b", "line", F.posexplode("line").alias("at", "node")).select("n", "l", "b", "node", F.when(F.col("at") > 0, F.get("line", F.col("at") - 1)).alias("parent"))
    node = steps.groupBy("node").agg(F.first("parent", True).alias("parent"), F.sum("n").alias("n"), F.sum("l").alias("l"), F.sum("b").alias("b"))
    node = common.written(node, "nodes")
    expected = (F.col("b") + prior * (F.col("n") - F.col("l"))) / F.col("n")
    children = node.filter("parent is not null and l > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("k"), F.sum(expected).alias("s"))
    facts = common.written(node.join(children, "node", "left").select("node", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("s", F.lit(0.0)).alias("s")), "facts")
    along = each.select("leaf", "l", "b", F.posexplode("line").alias("at", "node")).join(facts, "node")
    told = along.groupBy("leaf").agg(F.first("l").alias("l"), F.first("b").alias("b"), F.array_sort(F.collect_list(F.struct("at", "k", "s"))).alias("facts"))
    above = F.slice("facts", 1, F.size("facts") - 1)  # what the node's ancestors expect of a child
    hope = F.aggregate(above, F.lit(float(prior)), lambda m, f: (f["s"] + strength * m) / (f["k"] + strength))
    pure = told.select("leaf", ((F.col("b") + strength * hope) / (F.col("l") + strength)).alias("purity"))
    return lines.withColumn("leaf", last).join(pure, "leaf").select("host", "shape", F.array_join("template", "/").alias("template"), "n", "purity")


def templates(paths: DataFrame, fanout: int = 32, prior: float = 0.1, strength: float = 4.0, reject: float = 0.5, alike: float = 2.0, distance: float = 0.25) -> DataFrame:
    """paths: host, shape (array), n, labelled, bad, one row per host and shape. host, shape, n and the template, its purity and
    whether it is rejected."""
    now = wildcards(paths.withColumn("template", F.col("shape")), fanout)
    return purities(merges(now, alike, distance), prior, strength).withColumn("rejected", F.col("purity") >= reject)


def judge(pages: DataFrame, rules: list[tuple[str, str]], keep: tuple[str, ...] = ("page_id",), url: str = "url", **how) -> DataFrame:
    """One row per row of `pages`: the columns `keep`, host, path, rule (the one that decides, else null), template, purity
    and verdict (block or allow: the rule's, else the template tree's). Pages that a rule decides are the tree's labels.

    A null url or one without :// has an empty host and path and is judged like any other; repeated rows stay and count;
    extra columns are left out; an empty table gives no rows. Counts are summed before the shuffle, and hosts and shapes
    with very many pages are dealt to several tasks when verdicts are joined back."""
    host, path = host_and_path(F.col(url).cast("string"))
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("told", verdict).withColumn("shape", shapes(F.col("path")))
    counted = rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("told").alias("labelled"), F.count_if(F.col("told") == "block").alias("bad"))
    tree = common.written(templates(common.written(counted, "shapes"), **how), "tree")
    total = tree.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    found = common.salted_join(rows, tree, ["host", "shape"], "n", total, "left")
    return found.select(*keep, "host", "path", "rule", F.coalesce("told", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"), "template", "purity")
