"""Structured Streaming over event logs: trail consumer, keyed state machines, staleness (SM-1 to SM-14)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "seq long, at timestamp, kind string, run string, state string, revision long"
#: States of a job and where each may go.
TERMINAL = ("succeeded", "failed", "canceled")
NEXT = {"queued": ("running", "canceled"), "running": ("succeeded", "failed", "canceled", "queued")}


def trail(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """A folder of JSONL files as a stream; the checkpoint's offsets say what was read."""
    return spark.readStream.schema(schema).json(path)


def rates(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by kind and window; windows close once the watermark has passed."""
    return events.withWatermark("at", late).groupBy(F.window("at", width), "kind").agg(F.count("*").alias("n")).select("window.start", "window.end", "kind", "n")


def once(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """The first event of each key inside the watermark (idempotent create)."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def moved(state: str | None, to: str) -> str | None:
    """The next state of a job: an allowed move, else the state it had. Terminal states take nothing but a redrive to queued."""
    if state is None:
        return to if to == "queued" else None
    if state in TERMINAL:
        return "queued" if to == "redrive" else state
    return to if to in NEXT.get(state, ()) else state


def milliseconds(span: str) -> int:
    """A span such as "10 minutes" or "1 hour 30 minutes"."""
    found = re.findall(r"(\d+)\s*(second|minute|hour|day|week)s?", span)
    if not found or re.sub(r"\d+\s*(?:second|minute|hour|day|week)s?|\s", "", span):
        raise ValueError(f"not a span of time: {span!r}")
    return sum(int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}[unit] for n, unit in found) * 1000


def jobs(events: DataFrame, stale: str = "10 minutes", ttl: str = "7 days") -> DataFrame:
    """run, state, revision and attempts after each batch of a run's events; a running job that is silent for the watermark's
    length becomes stale. Events apply in seq order; a write with an old revision is passed over. An ended job leaves the state after
    `ttl`; others stay."""
    wait, life = milliseconds(stale), milliseconds(ttl)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, revision, attempts = state.get if state.exists else (None, -1, 0)
        if state.hasTimedOut:
            if now in TERMINAL:
                state.remove()
            if now == "running":
                now = "queued"
                state.update((now, revision, attempts))
                yield pd.DataFrame({"run": [key[0]], "state": ["stale"], "revision": [revision], "attempts": [attempts]})
            return
        rows = pd.concat(list(batches)).sort_values("seq")
        for to, seq in rows[["state", "seq"]].itertuples(index=False):
            if seq > revision:
                new = moved(now, to)
                attempts += new == "running" and now != "running"
                now, revision = new, int(seq)
        state.update((now, revision, int(attempts)))
        state.setTimeoutTimestamp(int(rows["at"].max().timestamp() * 1000) + (life if now in TERMINAL else wait))
        yield pd.DataFrame({"run": [key[0]], "state": [now], "revision": [revision], "attempts": [int(attempts)]})

    out = "run string, state string, revision long, attempts int"
    return events.withWatermark("at", stale).groupBy("run").applyInPandasWithState(fold, out, "state string, revision long, attempts int", "update", GroupStateTimeout.EventTimeTimeout)
