"""Where functions are defined, where a symbol really ends, and positions in texts: tables built once over all files and looked up
by equi-joins."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, scalars
from ..operators import skew
from ..operators.store import materialised

DEFINED = re.compile(r"\s*(?:async )?def (\w+)\(")
#: Code points of one bin of a text.
SPAN = 1024


def per_file(df: DataFrame, key: str, text: str, rows_of, schema: str, types: list[str]) -> DataFrame:
    """key and the rows that a function makes of each text."""
    names = [key, *(f.strip().split(" ")[0].strip("`") for f in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                columns = list(zip(*((k, *r) for r in rows_of(t or "")), strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, [batch.schema.field(0).type, *types], strict=True)], names)

    return df.select(key, text).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, {schema}")


def defined(text: str) -> list[tuple[str, int, int, str]]:
    """name, first and last line (from 1) and source of the first definition of each name. A body goes to the last line that isn't blank
    before the next line that begins without white space."""
    lines, found, seen, top = text.splitlines(), [], set(), 0
    for at, line in enumerate(lines):
        m = DEFINED.match(line)
        if m is None or m[1] in seen:
            continue
        seen.add(m[1])
        if top <= at:
            top = next((k for k in range(at + 1, len(lines)) if lines[k].strip() and lines[k][0] not in " \t"), len(lines))
        end = top
        while end > at + 1 and not lines[end - 1].strip():
            end -= 1
        found.append((m[1], at + 1, end, "\n".join(lines[at:end])))
    return found


def definitions(files: DataFrame, suffixes: tuple[str, ...] = (".py", ".pyi")) -> DataFrame:
    """path, name, start, end and source: the definitions of files (path, text) of an indented language, one a name and file."""
    own = files.filter(scalars.suffix_of(F.col("path")).isin(*suffixes))
    return per_file(own, "path", "text", defined, "name string, start int, `end` int, source string", ["string", "int32", "int32", "string"])


def located(wanted: DataFrame, known: DataFrame, key: list[str], name: str, file: str) -> DataFrame:
    """`wanted` (key, name, file: where the flow meets the method, or null) with path, start, end and source: the definition in that file,
    else the one of the first file by path that has the name; null where no file has it. known: `definitions`, written."""
    own = known.select(F.col("path").alias(file), F.col("name").alias(name), F.struct("path", "start", "end", "source").alias("__own"))
    first = known.groupBy(F.col("name").alias(name)).agg(F.min_by(F.struct("path", "start", "end", "source"), "path").alias("__any"))
    wanted = materialised(wanted)
    told = skew.keyed_join(wanted.join(own, [file, name], "left"), first, [name], "left", tuple(key))
    found = F.coalesce("__own", "__any")
    return told.select(*wanted.columns, *[found[c].alias(c) for c in ("path", "start", "end", "source")])


def lined(text: str) -> list[tuple[int, int, int, int, bool]]:
    """line (from 0), the last line up to it that isn't blank (-1: none), where it starts, its length without the break, and whether it
    declares something."""
    found, at, filled = [], 0, -1
    for n, line in enumerate(text.split("\n")):
        bare = line.strip()
        filled = n if bare else filled
        found.append((n, filled, at, len(line.rstrip("\r")), re.match(fixed.DECLARATION, bare) is not None))
        at += len(line) + 1
    return found


def lines(files: DataFrame) -> DataFrame:
    """path, line, filled, start, length and declares of every line of files (path, text)."""
    return per_file(files, "path", "text", lined, "line int, filled int, start long, length int, declares boolean", ["int32", "int32", "int64", "int32", "bool"])


def trimmed(ranges: DataFrame, lines: DataFrame, begins: DataFrame, keys: list[str]) -> DataFrame:
    """`ranges` (keys, path, start, end, end_char; lines from 0) whose end is pulled back over blank lines, then over one line that begins
    another symbol (begins: path, line) or declares one, and the blank lines before that; never before the start. end_char is then
    the length of the last line. lines: `lines`, written.

    Each step is a join with one row a line, so a file with many ranges isn't folded in one task."""
    last = lines.groupBy("path").agg(F.max("line").alias("__last"))
    now = ranges.join(last, "path", "left").withColumn("__to", F.least("end", F.coalesce("__last", F.col("end"))))

    def back(df: DataFrame) -> DataFrame:
        """`__to` goes to the last line that isn't blank."""
        at = lines.select("path", F.col("line").alias("__to"), F.col("filled").alias("__filled"))
        return df.join(at, ["path", "__to"], "left").withColumn("__to", F.when(F.col("__to") > F.col("start"), F.greatest("start", F.coalesce("__filled", F.col("__to")))).otherwise(F.col("__to"))).drop("__filled")

    now = back(now)
    told = lines.select("path", F.col("line").alias("__to"), "declares")
    other = begins.select("path", F.col("line").alias("__to"), F.lit(True).alias("__begins")).distinct()
    now = now.join(told, ["path", "__to"], "left").join(other, ["path", "__to"], "left")
    foreign = (F.col("__to") > F.col("start")) & (F.coalesce("declares", F.lit(False)) | F.coalesce("__begins", F.lit(False)))
    now = back(now.withColumn("__to", F.when(foreign, F.col("__to") - 1).otherwise(F.col("__to"))).drop("declares", "__begins"))
    widths = lines.select("path", F.col("line").alias("__to"), "length")
    moved = F.col("__to") < F.col("end")
    now = now.join(widths, ["path", "__to"], "left")
    return now.select(*keys, "path", "start", F.when(moved, F.col("__to")).otherwise(F.col("end")).alias("end"), F.when(moved, F.coalesce("length", F.lit(0))).otherwise(F.col("end_char")).alias("end_char"))


def local_names(files: DataFrame) -> DataFrame:
    """path, line (from 0) and name of what is defined anywhere in files (path, text)."""
    each = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "__line")).filter(F.col("__line").rlike(fixed.LOCAL_DEFINITION))
    return each.select("path", "line", F.explode(F.regexp_extract_all("__line", F.lit(fixed.LOCAL_DEFINITION), F.lit(1))).alias("name"))


def locally_defined(calls: DataFrame, names: DataFrame, how: str = "left_semi") -> DataFrame:
    """Calls (path, start and end of their scope, name ...) of names that their scope defines itself, or with left_anti the others: a
    semi join on (path, name) with lines in the scope."""
    n = names.alias("n")
    return calls.alias("c").join(n, (F.col("c.path") == F.col("n.path")) & (F.col("c.name") == F.col("n.name")) & F.col("n.line").between(F.col("c.start"), F.col("c.end")), how)


# --- positions ----------------------------------------------------------------------------------------------------------
def indexed(files: DataFrame) -> DataFrame:
    """path, line (from 0), start (code points before it), text (with its break) and last of every line: the index of positions."""

    def rows_of(text: str) -> list[tuple[int, int, str, bool]]:
        found, at = [], 0
        each = text.split("\n")
        for n, line in enumerate(each):
            whole = line if n == len(each) - 1 else line + "\n"
            found.append((n, at, whole, n == len(each) - 1))
            at += len(whole)
        return found

    return per_file(files, "path", "text", rows_of, "line int, start long, text string, last boolean", ["int32", "int64", "string", "bool"])


def units(text: F.Column) -> F.Column:
    return scalars.utf16_length(text)


def taken(text: F.Column, count: F.Column) -> F.Column:
    """How many code points of a line its first `count` UTF-16 units touch; texts without pairs have as many of either."""
    pairs = F.aggregate(
        F.split(text, ""), F.struct(F.lit(0).alias("units"), F.lit(0).alias("points")),
        lambda a, c: F.when(a["units"] >= count, a).otherwise(F.struct((a["units"] + units(c)).alias("units"), (a["points"] + F.length(c)).alias("points"))),
    )["points"]
    return F.when(count <= 0, 0).when(units(text) == F.length(text), F.least(count, F.length(text))).otherwise(pairs).cast("int")


def offsets(positions: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """keys and offset (code points) of positions (keys, path, line, character in UTF-16 units). A line before the text is its begin, one
    behind it its end; a character behind a line's end is the end of the line, its break included."""
    ends = index.filter("last").select("path", F.col("line").alias("__lines"), (F.col("start") + F.length("text")).alias("__end"))
    at = index.select("path", "line", "start", F.col("text").alias("__text"))
    told = positions.join(ends, "path").join(at, ["path", "line"], "left")
    return told.select(*keys, F.when(F.col("line") < 0, F.lit(0)).when(F.col("line") > F.col("__lines"), F.col("__end")).otherwise(F.col("start") + taken(F.col("__text"), F.col("character"))).cast("long").alias("offset"))


def positions(offsets: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line and character (UTF-16 units) of offsets (keys, path, offset), clamped to the text. A line stands in each bin of code
    points that it touches, so a long text isn't one key."""
    ends = index.filter("last").select("path", (F.col("start") + F.length("text")).alias("__end"))
    at = offsets.join(ends, "path").withColumn("__at", F.greatest(F.lit(0), F.least("offset", "__end"))).withColumn("__bin", F.floor(F.col("__at") / SPAN))
    stop = F.col("start") + F.length("text")
    binned = index.withColumn("__stop", stop).withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start") / SPAN), F.floor(F.col("__stop") / SPAN))))
    inside = at.join(binned, ["path", "__bin"]).filter((F.col("__at") >= F.col("start")) & ((F.col("__at") < F.col("__stop")) | F.col("last")))
    return inside.select(*keys, "line", units(F.substring(F.col("text"), F.lit(1), (F.col("__at") - F.col("start")).cast("int"))).alias("character"))
