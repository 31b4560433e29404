"""Reading of model answers that may be cut off: repair, turns and isolated failures."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How many of the last places where a value ends are tried, and how many calls of a turn count.
MOST_CUTS, MOST_CALLS = 40, 8


def repaired(text: str | None, required: tuple[str, ...] = ()) -> str | None:
    """The text if it is a JSON object; else the longest cut at the end of a value that becomes one by closing what is open.
    The object must have the required fields."""
    if not text or "{" not in text:
        return None
    text = text[text.index("{") :]
    ends: list[tuple[int, str]] = []
    stack: list[str] = []
    inside = escaped = False
    for i, ch in enumerate(text):
        if inside:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                inside = False
                ends.append((i + 1, "".join(reversed(stack))))
            continue
        if ch == '"':
            inside = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]" and stack:
            stack.pop()
            ends.append((i + 1, "".join(reversed(stack))))
        elif ch == ",":
            ends.append((i, "".join(reversed(stack))))
    for end, close in reversed(ends[-MOST_CUTS:]):
        try:
            value = json.loads(text[:end].rstrip().rstrip(",") + close)
        except ValueError:
            continue
        if isinstance(value, dict) and all(k in value for k in required):
            return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return None


def repaired_all(texts: pd.Series) -> pd.Series:
    return texts.map(repaired)


def repair(text: Column) -> Column:
    """`repaired` over Arrow batches."""
    return F.pandas_udf(repaired_all, "string")(text)


def calls(answer: Column) -> Column:
    """array<struct<tool, arguments>>: the calls of a turn, at most MOST_CALLS; empty for a final answer."""
    parsed = F.from_json(answer, "calls array<struct<tool:string,arguments:map<string,string>>>")["calls"]
    return F.slice(F.filter(F.coalesce(parsed, F.array().cast("array<struct<tool:string,arguments:map<string,string>>>")), lambda c: c["tool"].isNotNull()), 1, MOST_CALLS)


def isolated(df: DataFrame, key: str, value: str, work: Callable[[str], str]) -> DataFrame:
    """key, result and error: a failing row leaves its message and doesn't stop the others."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            out = []
            for k, v in rows.itertuples(index=False):
                try:
                    out.append((k, work(v), None))
                except Exception as e:  # noqa: BLE001
                    out.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "result", "error"])

    return df.select(key, value).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, result string, error string")
