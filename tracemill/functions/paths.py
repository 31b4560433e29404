"""Paths that others report: percent codes, normal forms, and the file of an inventory that a foreign path means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed, scalars


def decoded(uri: Column) -> Column:
    """Percent codes as their characters; a plus stays a plus, and a text with a code that is none stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), uri)


def encoded(path: Column) -> Column:
    """A path as a file URI: everything but letters, digits, `/` and `_.-~` as percent codes."""
    out = F.url_encode(path)
    for code, text in (("%2F", "/"), ("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(text))
    return F.concat(F.lit("file://"), out)


def plain(path: Column) -> Column:
    """Forward slashes, trimmed, and without `file://` and its percent codes."""
    bare = F.trim(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.when(F.startswith(bare, F.lit("file://")), F.replace(decoded(F.substring(bare, 8, 1 << 20)), F.lit("\\"), F.lit("/"))).otherwise(bare)


def parts(path: Column) -> Column:
    """The parts of a path without empty ones, dots, and what a `..` takes back."""
    each = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    return F.aggregate(each, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.lit(0), F.size(a) - 1))).otherwise(F.concat(a, F.array(p))))


def absolute(path: Column) -> Column:
    return path.rlike("^(/|[A-Za-z]:(/|$))")


def relative(path: Column, root: Column) -> Column:
    """A path below the root without it; others as they are."""
    below = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, below), F.substring(path, F.length(below) + 1, F.length(path))).otherwise(path)


def language(path: Column) -> Column:
    """The language of a file by its suffix, the suffix without its dot where that isn't known, and null without one."""
    suffix = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"[^.](\.[^.]+)$", 1)
    return F.coalesce(scalars.lookup(F.lower(suffix), fixed.LANGUAGE_OF_SUFFIX), scalars.nonempty(F.substring(suffix, 2, 1 << 10)))


def rebased(paths: DataFrame, inventory: DataFrame, key: str, path: str, known: str, root: str = "/") -> DataFrame:
    """key, rebased and how: what a reported path is in a project whose files are `inventory` (paths below the root).

    relative: not absolute, in its normal form. inside: below the root. suffix: the longest end of the path, of two parts at least, that
    is a file and doesn't begin with a scaffold folder. name: the only file of that name, hidden and scaffold folders aside. Else
    the longest end that doesn't begin with a scaffold folder, as refused where several files have the name and unknown where none has.

    The ends of all paths meet the inventory in one equi-join; names are summed up to one row before they meet."""
    from ..operators import skew
    from ..operators.store import materialised

    told = paths.select(key, plain(F.col(path)).alias("__raw"))
    told = told.withColumn("__p", parts(F.col("__raw"))).withColumn("__abs", absolute(F.col("__raw")))
    top = "/" + root.strip("/")
    clean = F.concat(F.lit("/"), F.array_join("__p", "/"))
    below = F.col("__abs") & F.startswith(clean, F.lit(top.rstrip("/") + "/")) & F.lit(top != "/")
    told = materialised(told.withColumn("__inside", F.when(below, relative(clean, F.lit(top)))).withColumn("__name", F.try_element_at("__p", F.lit(-1))))
    foreign = told.filter(F.col("__abs") & F.col("__inside").isNull())
    n = F.size("__p")
    cuts = F.when(n > 2, F.sequence(F.lit(2), n - 1)).otherwise(F.array().cast("array<int>"))
    ends = foreign.select(key, F.explode(F.transform(cuts, lambda i: F.struct(i.alias("cut"), F.array_join(F.slice("__p", i, n), "/").alias("__end"), F.element_at("__p", i).alias("first")))).alias("e")).select(key, "e.*")
    files = inventory.select(F.col(known).alias("__end")).distinct()
    found = skew.keyed_join(materialised(ends.filter(~F.col("first").isin(*fixed.SCAFFOLD_FOLDERS))), files, ["__end"], "left_semi", (key,)).groupBy(key).agg(F.min_by("__end", "cut").alias("__suffix"))
    folders = F.slice(F.split("__end", "/"), 1, F.greatest(F.lit(0), F.size(F.split("__end", "/")) - 1))
    open_files = files.filter(~F.exists(folders, lambda d: F.startswith(d, F.lit(".")) | d.isin(*fixed.SCAFFOLD_FOLDERS)))
    names = open_files.groupBy(F.element_at(F.split("__end", "/"), -1).alias("__name")).agg(F.count("*").alias("__files"), F.min("__end").alias("__only"))
    whole = skew.keyed_join(told, names, ["__name"], "left", (key,)).join(found, key, "left")
    kept = F.filter(F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>")), lambda i: ~F.element_at("__p", i).isin(*fixed.SCAFFOLD_FOLDERS))
    guess = F.when(F.size(kept) > 0, F.array_join(F.slice("__p", F.element_at(kept, 1), n), "/")).otherwise(F.ltrim("__raw", F.lit("/")))
    how = F.when(F.col("__raw") == "", "relative").when(~F.col("__abs"), "relative").when(F.col("__inside").isNotNull(), "inside").when(F.col("__suffix").isNotNull(), "suffix").when(F.col("__files") == 1, "name").when(F.col("__files") > 1, "refused").otherwise("unknown")
    normal = F.array_join(F.filter(F.split("__raw", "/"), lambda p: ~p.isin("", ".")), "/")
    value = F.when(~F.col("__abs"), normal).when(F.col("__inside").isNotNull(), F.col("__inside")).when(F.col("__suffix").isNotNull(), F.col("__suffix")).when(F.col("__files") == 1, F.col("__only")).otherwise(guess)
    return whole.select(key, value.alias("rebased"), how.alias("how"))
