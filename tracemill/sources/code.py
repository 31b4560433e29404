"""Text extraction: grep, call sites, method scopes, path rebasing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.fixed import NOT_CALLS
from ..operators.skew import dealt

CALL, DEF, CLASS = (re.compile(p) for p in (fixed.CALL, fixed.DEF, fixed.CLASS))
BRACED = re.compile(r"^\s*(?:(?:public|private|protected|static|final|export|async|func|fun|function)\s+)*(?:[\w<>\[\],.?]+\s+)?([A-Za-z_]\w*)\s*\([^;{]*\)\s*(?:throws\s+[\w, .]+)?\{\s*$")


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 1) and line."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line")).select(key, (F.col("at") + 1).alias("line_no"), "line")


def grep(df: DataFrame, key: str, text: str, pattern: str, width: int = 400) -> DataFrame:
    """Lines with a match of a Java regular expression, trimmed and cut; texts without one are left out before they are split, unless the
    pattern can tell a line from a text (anchors, groups with a question mark)."""
    whole = df if re.search(r"[\^$]|\\[AzZGR]|\(\?", pattern) else df.filter(F.col(text).rlike(pattern))
    return lines(whole, key, text).filter(F.col("line").rlike(pattern)).select(key, "line_no", F.substring(F.trim("line"), 1, width).alias("line"))


def rebased(paths: DataFrame, inventory: DataFrame, key: str, path: str, known: str) -> DataFrame:
    """key and rebased: the longest suffix of a path, cut at slashes, that the inventory has."""
    parts = F.split(path, "/")
    suffixes = paths.select(key, F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("cut", "suffix"))
    return suffixes.join(inventory, F.col("suffix") == F.col(known)).groupBy(key).agg(F.min_by("suffix", "cut").alias("rebased"))


def calls_in(text: str) -> list[tuple[int, int, str | None, str]]:
    """line (from 1), column (from 0), receiver and name of call sites; a line that declares a function or a class has none."""
    found = []
    for n, line in enumerate(text.split("\n"), 1):
        if DEF.match(line) or CLASS.match(line) or BRACED.match(line) and BRACED.match(line)[1] not in NOT_CALLS:
            continue
        for m in CALL.finditer(line):
            if m[2] not in NOT_CALLS:
                found.append((n, m.start(2), m[1], m[2]))
    return found


def call_sites(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, col, receiver and name of each call site; Spark has no match positions, so Arrow batches do it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *c) for k, t in zip(batch[key].to_pylist(), batch[text].to_pylist(), strict=True) for c in calls_in(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((batch.schema.field(key).type, "int32", "int32", "string", "string"))], [key, "line_no", "col", "receiver", "name"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, line_no int, col int, receiver string, name string")


def indented_methods(text: str) -> list[tuple[str, int, int, str | None]]:
    """name, first and last line (from 0) and class of the functions of an indented language. Functions inside functions are
    passed over; decorators belong to the function."""
    rows, found, at = text.split("\n"), [], 0
    while at < len(rows):
        m = DEF.match(rows[at])
        if not m:
            at += 1
            continue
        depth, end = len(m[1].expandtabs(4)), at
        for k in range(at + 1, len(rows)):
            if rows[k].strip():
                if len(rows[k].expandtabs(4)) - len(rows[k].expandtabs(4).lstrip()) <= depth:
                    break
                end = k
        begin = at
        while begin and rows[begin - 1].strip().startswith("@"):
            begin -= 1
        owner = next((c[2] for k in range(at - 1, -1, -1) if (c := CLASS.match(rows[k])) and len(c[1].expandtabs(4)) < depth), None)
        found.append((m[2], begin, end, owner))
        at = end + 1
    return found


MODIFIERS = r"(?:(?:export|default|public|private|protected|static|final|abstract|async|override|virtual|inline|extern|synchronized)\s+)*"
NAME = r"([A-Za-z_$][\w$]*)"
#: How a function of a braced language may begin: by a keyword, as a value of a name, with a type or bare before its brace, or with a receiver.
FORMS = tuple(
    re.compile(r"^\s*" + p)
    for p in (
        MODIFIERS + r"(?:function\*?|fun|fn)\s+" + NAME + r"\s*[(<]",
        MODIFIERS + r"(?:(?:const|let|var)\s+)?" + NAME + r"\s*[:=]\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=]+)?=>)",
        MODIFIERS + r"(?:[A-Za-z_$<][\w$:<>,.?*&\[\]]*\s+[*&]?)*?" + NAME + r"\s*\([^;{}]*\)\s*(?:(?:const|noexcept|override)\s*)*(?:throws\s+[\w.,\s]+|->\s*[\w:<>,*&\s]+)?(?:\{.*)?$",
        r"func\s+(?:\([^)]*\)\s*)?" + NAME + r"\s*[(\[]",
    )
)
NOT_CODE = ("//", "*", "/*", "#")


def braced_name(rows: list[str], at: int) -> str | None:
    """The name of the function that begins on a line; one without a brace on it needs a brace on the next line that isn't blank, but for
    the forms that a keyword or a value tells."""
    if not rows[at].strip() or rows[at].strip().startswith(NOT_CODE):
        return None
    for k, form in enumerate(FORMS):
        m = form.match(rows[at])
        if m is None or m[1] in NOT_CALLS or re.match(r"\s*(?:return|throw|new|else|case|await|yield)\b", rows[at]):
            continue
        if k != 2 or "{" in rows[at][m.end(1) :]:
            return m[1]
        following = next((r for r in rows[at + 1 :] if r.strip()), "")
        if following.strip().startswith("{"):
            return m[1]
    return None


def braced_methods(text: str, fallback: int = 60) -> list[tuple[str, int, int, str | None]]:
    """name, first and last line of the functions of a braced language, in one of four forms; an open brace that isn't closed, or none, ends
    after `fallback` lines."""
    rows, found = text.split("\n"), []
    bare = [re.sub(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|//.*$', "", r) for r in rows]
    for at in range(len(rows)):
        name = braced_name(bare, at)
        if name is None:
            continue
        depth, opened, end = 0, False, min(len(rows) - 1, at + fallback)
        for k in range(at, len(rows)):
            depth += bare[k].count("{") - bare[k].count("}")
            opened = opened or "{" in bare[k]
            if opened and depth <= 0:
                end = k
                break
            if not opened and k - at >= fallback:
                break
        found.append((name, at, end, None))
    return found


PARSERS = {".py": indented_methods, ".java": braced_methods, ".js": braced_methods, ".ts": braced_methods, ".go": braced_methods, ".kt": braced_methods}


def methods(df: DataFrame, path: str, text: str) -> DataFrame:
    """path, name, start, end (lines from 0) and owner of the methods of each file, by the parser of its suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, t in zip(batch[path].to_pylist(), batch[text].to_pylist(), strict=True):
                parser = PARSERS.get("." + (p or "").rpartition(".")[2])
                rows += [(p, *m) for m in (parser(t or "") if parser else [])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(("string", "string", "int32", "int32", "string"))], ["path", "name", "start", "end", "owner"])

    return df.select(path, text).mapInArrow(run, "path string, name string, start int, `end` int, owner string")


def innermost_calls(files: DataFrame) -> DataFrame:
    """Edges from each file's innermost method to called names, for files (path, text); first call of a pair wins. Files and what is found
    in them are dealt by number: texts are read from a few bytes, and most of the work is in Python."""
    files = dealt(files.select("path", "text"), "path")
    scopes = dealt(methods(files, "path", "text"), "path")
    sites = dealt(call_sites(files, "path", "text"), "path").withColumn("at", F.col("line_no") - 1)
    inside = sites.join(scopes.withColumnRenamed("name", "caller"), "path").filter("at > start and at <= `end`")
    w = Window.partitionBy("path", "line_no", "col").orderBy(F.col("end") - F.col("start"), F.col("start").desc())
    best = inside.withColumn("n", F.row_number().over(w)).filter("n = 1 and name != caller")
    return best.groupBy("path", "caller", F.col("name").alias("callee")).agg(F.min(F.struct("line_no", "col")).alias("first")).select("path", "caller", "callee", "first.line_no", "first.col")
