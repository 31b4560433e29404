"""The packet of source that a judge of a candidate reads: blocks in order of importance under a budget of characters.

The candidate's own place comes first, with the function around it, then the functions along its path. A block that is
too long for what is left of the budget keeps its head; a path step inside a block that is there adds nothing.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Padding of a statement, gap at which windows join, lines of a block, characters of a packet and what a cut leaves.
PADDING, GAP, MOST_LINES, BUDGET, HEAD = 2, 6, 400, 12_000, 200
CUT = "\n…（本段因预算被截断）"
BLOCK = "candidate_id {id}, place int, file string, start int, `end` int, text string, truncated boolean, outcome string"


@lru_cache(maxsize=8)
def functions(text: str) -> list[tuple[int, int]]:
    """First and last lines (from 1) of the functions of a Python source; none if it isn't one."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    return [(n.lineno, n.end_lineno) for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]


def windows(text: str, line: int, own: bool) -> list[tuple[int, int, str, bool]]:
    """start, end, numbered text and whether lines were cut, of what to show around a line."""
    rows = text.split("\n")
    around = max((s for s in functions(text) if s[0] <= line <= s[1]), key=lambda s: s[0], default=None)
    near = (line - PADDING, line + PADDING)
    wanted = [near, around] if own and around else [around or near]
    joined: list[list[int]] = []
    for a, b in sorted((max(1, a), min(len(rows), b)) for a, b in wanted):
        if joined and a <= joined[-1][1] + GAP:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    out = []
    for a, b in joined:
        last = min(b, a + MOST_LINES - 1)
        if a <= b:
            out.append((a, last, "\n".join(f"{n:>5} | {rows[n - 1]}" for n in range(a, last + 1)), last < b))
    return out


def packets(candidates: DataFrame, files: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Blocks of each candidate (candidate_id, file, line, path: array of file:line texts) from files (path, text), in order: place, file,
    start, end, text, truncated and outcome: shown, no budget (left out) or unreadable (no such file).

    A candidate's windows are cut before they meet, and its blocks pass one task in order, as a stream that holds what it has shown."""
    steps = F.concat(F.array(F.concat(F.col("file"), F.lit(":"), F.coalesce("line", F.lit(1)).cast("string"))), F.coalesce("path", F.array().cast("array<string>")))
    each = candidates.select("candidate_id", F.posexplode(steps).alias("at", "step"))
    each = each.select("candidate_id", "at", F.regexp_extract("step", r"^([^\s:]+):(\d+)\b", 1).alias("file"), F.regexp_extract("step", r"^([^\s:]+):(\d+)\b", 2).try_cast("int").alias("line")).filter("file != ''")
    known = each.join(files.select(F.col("path").alias("file"), "text"), "file", "left").select("candidate_id", "at", "file", "line", "text")
    # parsing is the work here, so rows are dealt by number, also those of one file, and not merged by their few bytes
    known = known.repartition(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")), "candidate_id", "file")
    kind = candidates.schema["candidate_id"].dataType.simpleString()

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            out = []
            for c, at, file, line, text in rows.itertuples(index=False):
                shown = [(0, 0, None, False)] if text is None else windows(text, int(line), at == 0)
                out += [(c, at, file, line, *w) for w in shown]
            yield pd.DataFrame(out, columns=["candidate_id", "at", "file", "line", "start", "end", "text", "truncated"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, place, shown, seen = object(), budget, 0, [], set()
        for batch in batches:
            out = []
            for c, at, file, line, start, end, text, short in zip(*(x.to_pylist() for x in batch), strict=True):
                if c != now:
                    now, left, place, shown, seen = c, budget, 0, [], set()
                if text is None:
                    out.append((c, place, file, None, None, None, False, "unreadable"))
                    place += 1
                    continue
                if at and ((file, start, end) in seen or any(f == file and a <= line <= b for f, a, b in shown)):
                    continue
                if at:
                    seen.add((file, start, end))
                outcome = "shown"
                if len(text) > left:
                    head = max(0, left - HEAD)
                    if head < HEAD:
                        text, short, outcome = None, False, "no budget"
                    else:
                        text, short = text[:head] + CUT, True
                if text is not None:
                    left -= len(text)
                    shown.append((file, start, end))
                out.append((c, place, file, start, end, text, short, outcome))
                place += 1
            types = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], t) for i, t in enumerate(types)], ["candidate_id", "place", "file", "start", "end", "text", "truncated", "outcome"])

    blocks = known.mapInPandas(cut, f"candidate_id {kind}, at int, file string, line int, start int, `end` int, text string, truncated boolean")
    ordered = blocks.repartition("candidate_id").sortWithinPartitions("candidate_id", "at", "start", "file", "end", "text")
    return ordered.mapInArrow(fold, BLOCK.format(id=kind))
