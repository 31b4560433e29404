"""Named table functions over the files of a workspace, and providers that are given from outside.

Calls are rows (call_id, arguments as a map of texts); answers are rows (call_id, ok, summary, data as JSON, truncated). Every call
is answered. Few calls are the broadcast side and every file is looked at in place; beyond `MOST_BROADCAST` reads meet their file
by path, and patterns go over the files in groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, scalars
from . import rows, skew
from .store import materialised

#: Arguments of each function: those it needs and those it may have.
SCHEMAS = {
    "read": (("path",), ("offset", "limit")),
    "grep": (("pattern",), ("path", "include", "limit")),
    "list_files": ((), ("prefix", "pattern", "limit")),
    "board": (("section",), ("limit",)),
    "dataflow_verify": (("file", "line"), ()),
    "record": (("kind", "title"), ("file", "line", "detail")),
}
MOST_BROADCAST = 1000
GROUP = 256
ANSWER = "call_id", "ok", "summary", "data", "truncated"


def checked(calls: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Calls whose arguments fit the function's closed schema, and answers for those that don't."""
    needed, optional = SCHEMAS[name]
    lacking = F.array_except(F.array(*map(F.lit, needed)).cast("array<string>"), F.map_keys("arguments"))
    foreign = F.array_except(F.map_keys("arguments"), F.array(*map(F.lit, needed + optional)).cast("array<string>"))
    wrong = F.when(F.size(lacking) > 0, F.concat(F.lit("missing: "), F.array_join(lacking, ", "))).when(F.size(foreign) > 0, F.concat(F.lit("unknown: "), F.array_join(foreign, ", ")))
    if name == "grep":
        blank = F.trim(F.coalesce(F.col("arguments")["pattern"], F.lit(""))) == ""
        wrong = F.coalesce(wrong, F.when(blank, "pattern: empty"))
    for c in ("path", "pattern", "include") if name != "grep" else ("path", "include"):
        if c in needed + optional:
            wrong = F.coalesce(wrong, F.when(escaping(F.col("arguments")[c]), f"{c}: outside the workspace"))
    told = calls.withColumn("__bad", wrong)
    refused = told.filter("__bad is not null").select("call_id", F.lit(False).alias("ok"), F.col("__bad").alias("summary"), F.lit("[]").alias("data"), F.lit(False).alias("truncated"))
    return told.filter("__bad is null").drop("__bad"), refused


def escaping(path: Column) -> Column:
    """Whether a path or pattern is rooted or goes up."""
    bare = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.coalesce(bare.rlike("^(/|[A-Za-z]:)") | F.concat(F.lit("/"), bare, F.lit("/")).contains("/../"), F.lit(False))


def glob(pattern: Column) -> Column:
    """A glob as a regular expression: `**/` is any folders, `*` and `?` stay within a name."""
    plain = F.regexp_replace(pattern, r"([.+^${}()|\[\]\\])", r"\\$1")
    for mark, text in (("**/", "\x01"), ("**", "\x02"), ("*", "[^/]*"), ("?", "[^/]"), ("\x01", "(?:[^/]+/)*"), ("\x02", ".*")):
        plain = F.replace(plain, F.lit(mark), F.lit(text))
    return F.concat(F.lit("^"), plain, F.lit("$"))


def shown(path: Column) -> Column:
    """Whether a file is told of: no folder on its way is hidden or skipped."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1))
    return ~F.exists(folders, lambda d: F.startswith(d, F.lit(".")) | d.isin(*fixed.SURVEY_SKIPS))


def number(name: str, default: int) -> F.Column:
    return F.coalesce(F.col("arguments")[name].try_cast("int"), F.lit(default))


def met(files: DataFrame, calls: DataFrame) -> DataFrame:
    """Every file with every call: few calls are broadcast, more meet the files in groups of `GROUP`. The work is in the pairs, so files
    are dealt by number, not by the few bytes they are read from."""
    files = files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    if calls.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        return files.join(F.broadcast(calls))
    grouped = rows.ordinal(calls, "__at", F.col("call_id")).groupBy(F.floor(F.col("__at") / GROUP).alias("__group")).agg(F.collect_list(F.struct(*calls.columns)).alias("__calls"))
    grouped = materialised(grouped)
    each = files.withColumn("__group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grouped.count() - 1).cast("long"))))
    return each.join(grouped, "__group").withColumn("__call", F.explode("__calls")).select(*files.columns, "__call.*")


def answers(calls: DataFrame, hits: DataFrame, most: int, *order: str) -> DataFrame:
    """One answer a call from its hits (call_id, n, first, limit): `first` holds the first ones of what it was looked for in, at most `most`, `n`
    how many there are. The first ones in order are kept, as many as the call's limit; only these meet in a row."""
    hits = materialised(hits)
    total = hits.groupBy("call_id").agg(F.sum("n").alias("__n"), F.any_value("limit").alias("__most"))
    each = hits.select("call_id", "limit", F.explode("first").alias("__hit")).select("call_id", "limit", "__hit.*")
    place = F.row_number().over(Window.partitionBy("call_id").orderBy(*order))
    kept = each.withColumn("__place", place).filter(F.col("__place") <= most).filter(F.col("__place") <= F.col("limit"))
    lists = kept.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("__rows"))
    both = calls.select("call_id").join(total, "call_id", "left").join(lists, "call_id", "left")
    data = F.coalesce(F.to_json("__rows"), F.lit("[]"))
    return both.select("call_id", F.lit(True).alias("ok"), F.concat(F.coalesce("__n", F.lit(0)).cast("string"), F.lit(" found")).alias("summary"), data.alias("data"), F.coalesce(F.col("__n") > F.col("__most"), F.lit(False)).alias("truncated"))


def call(name: str, files: DataFrame, calls: DataFrame, most: int = 200) -> DataFrame:
    """Answers of the named function for all calls. files: path, text; for `board` items: section, place, item; for
    `dataflow_verify` an engine's answers, one a place: file, line, outcome, flow (array of steps); for `record` the kinds that may be recorded: kind.

    `read` gives lines from `offset`; `grep` the lines that match, of files below `path` whose name fits `include`; `list_files` paths
    that begin with `prefix` and fit the glob `pattern`; `board` the first items of a section; each tells the exact total. `dataflow_verify` tells what the engine found out about a place, `record`
    gives back what may be appended to a trail."""
    good, refused = checked(materialised(calls), name)
    limit = F.least(number("limit", most), F.lit(most))
    if name == "read":
        first, n = number("offset", 1), F.greatest(F.lit(0), limit)
        lines = F.split("text", "\n")
        asked = good.withColumn("__path", F.col("arguments")["path"])
        cut = F.slice(lines, F.greatest(F.lit(1), first), n)
        if good.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
            both = files.join(F.broadcast(asked), files["path"] == F.col("__path"))
        else:  # by number: compressed texts are many rows a partition
            both = skew.dealt(files, "path").join(skew.dealt(asked, "__path"), F.col("path") == F.col("__path"))
        found = both.select("call_id", cut.alias("l"), F.size(lines).alias("total"), first.alias("first"))
        told = skew.dealt(good.select("call_id"), "call_id").join(skew.dealt(found, "call_id"), "call_id", "left")
        summary = F.when(F.col("l").isNull(), "no such file").otherwise(F.concat(F.size("l").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" lines")))
        rest = F.coalesce(F.col("first") - 1 + F.size("l") < F.col("total"), F.lit(False))
        out = told.select("call_id", F.col("l").isNotNull().alias("ok"), summary.alias("summary"), F.to_json(F.coalesce("l", F.array().cast("array<string>"))).alias("data"), rest.alias("truncated"))
    elif name == "grep":
        pattern, below, fits = F.col("arguments")["pattern"], F.col("arguments")["path"], F.col("arguments")["include"]
        inside = F.coalesce((below.isin("", ".")) | (F.col("path") == below) | F.startswith("path", F.concat(F.rtrim(below, F.lit("/")), F.lit("/"))), F.lit(True))
        # lines and names are cut once a file and globs read once a call, before they meet; only files with a hit get numbered lines
        cut = files.select("path", F.element_at(F.split("path", "/"), -1).alias("__name"), F.split("text", "\n").alias("__lines"))
        asked = good.withColumn("__glob", glob(fits))
        found = met(cut, asked).filter(inside).filter(F.coalesce(F.regexp("__name", F.col("__glob")), F.lit(True))).filter(F.exists("__lines", lambda x: F.regexp(x, pattern)))
        lines = F.transform("__lines", lambda line, i: F.struct(F.col("path").alias("path"), (i + 1).alias("line"), line.alias("content")))
        found = found.select("call_id", limit.alias("limit"), F.filter(lines, lambda x: F.regexp(x["content"], pattern)).alias("m"))
        cut = F.transform(F.slice("m", 1, most), lambda x: F.struct(x["path"].alias("path"), x["line"].alias("line"), F.substring(F.trim(x["content"]), 1, 400).alias("content")))
        out = answers(good, found.select("call_id", "limit", F.size("m").alias("n"), cut.alias("first")), most, "path", "line", "content")
    elif name == "list_files":
        prefix, fits = F.coalesce(F.col("arguments")["prefix"], F.lit("")), F.col("arguments")["pattern"]
        found = met(files.select("path").filter(shown(F.col("path"))), good).filter(F.startswith("path", prefix) & F.coalesce(F.regexp(F.col("path"), glob(fits)), F.lit(True)))
        out = answers(good, found.select("call_id", limit.alias("limit"), F.lit(1).alias("n"), F.array(F.struct("path")).alias("first")), most, "path")
    elif name == "dataflow_verify":
        asked = good.select("call_id", F.col("arguments")["file"].alias("__file"), F.col("arguments")["line"].try_cast("int").alias("__line"))
        told = asked.join(files, (F.col("__file") == files["file"]) & (F.col("__line") == files["line"]), "left")
        ok = F.coalesce(~F.col("outcome").isin("error", "fallback"), F.lit(False))
        out = told.select("call_id", ok.alias("ok"), F.coalesce("outcome", F.lit("no such place")).alias("summary"), F.to_json(F.coalesce("flow", F.array().cast("array<string>"))).alias("data"), F.lit(False).alias("truncated"))
    elif name == "record":
        known = good.join(F.broadcast(files.select(F.col("kind").alias("__kind")).distinct().limit(MOST_BROADCAST)), F.col("arguments")["kind"] == F.col("__kind"), "left")
        fits = F.col("__kind").isNotNull() & (F.trim(F.col("arguments")["title"]) != "")
        out = known.select("call_id", fits.alias("ok"), F.when(fits, "recorded").otherwise("unknown kind or empty title").alias("summary"), F.when(fits, F.concat(F.lit("["), scalars.sorted_json(F.col("arguments")), F.lit("]"))).otherwise("[]").alias("data"), F.lit(False).alias("truncated"))
    else:
        found = files.join(good, files["section"] == F.col("arguments")["section"])
        out = answers(good, found.select("call_id", limit.alias("limit"), F.lit(1).alias("n"), F.array(F.struct("place", "item")).alias("first")), most, "place", "item")
    return out.select(*ANSWER).unionByName(refused)


def provided(contexts: DataFrame, key: str, text: str, provider: Callable[[str], str], retries: int = 2) -> DataFrame:
    """key, answer, attempts and error of one call of an injected provider a context: a model, or an engine of data flows. A call that
    fails is tried again; what fails to the end leaves its message, and the other rows go on."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            out = []
            for k, value in rows.itertuples(index=False):
                for attempt in range(1, retries + 2):
                    try:
                        out.append((k, provider(value), attempt, None))
                        break
                    except Exception as e:  # noqa: BLE001
                        if attempt > retries:
                            out.append((k, None, attempt, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "answer", "attempts", "error"])

    return contexts.select(key, text).mapInPandas(run, f"`{key}` {dict(contexts.dtypes)[key]}, answer string, attempts int, error string")
