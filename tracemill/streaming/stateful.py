"""Keyed state that expires, retracts and fires: the machines of `operators.inbox` and the versions of `operators.evidence` as streams.

All use transformWithState: value, list and map state in the state store, event-time timers where a clock decides. A session needs
a state store that keeps columns (`STORE`).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.evidence import OVERTAKEN
from ..operators.inbox import HELD, PLANNED, Inbox, Job, Planner

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def framed(key: Any, rows: list[tuple], schema: str, name: str) -> pd.DataFrame:
    return pd.DataFrame([(key, *r) for r in rows], columns=[name, *names(schema)]).astype({f.split()[0]: "Int32" for f in schema.split(", ") if f.split()[1] == "int"})


class Timed(StatefulProcessor):
    """One machine a key: its fields as a value, and a timer for when its clock moves next."""

    def __init__(self, key: str, schema: str, columns: list[str]):
        self.key, self.schema, self.columns = key, schema, columns

    def fresh(self) -> Inbox | Job:
        raise NotImplementedError

    def fields(self, machine: Any) -> dict:
        raise NotImplementedError

    def gone(self, machine: Any) -> bool:
        """Whether nothing about the key is to be remembered."""
        return False

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.value = handle.getValueState("machine", "fields string")

    def machine(self) -> Inbox | Job:
        held = self.fresh()
        if self.value.exists():
            for name, v in json.loads(self.value.get()[0]).items():
                setattr(held, name, v)
        return held

    def kept(self, machine: Inbox | Job) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if self.gone(machine):
            self.value.clear()
            return
        self.value.update((json.dumps(self.fields(machine)),))
        at = machine.next()
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, out = self.machine(), []
        every = pd.concat(list(rows)).sort_values(["at", "seq"]).astype(object)
        every = every.where(every.notna(), None)
        for event in every[self.columns].itertuples(index=False):
            out += held.event(int(event[0]), *event[1:])
        self.kept(held)
        yield framed(key[0], out, self.schema, self.key)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.machine()
        out = held.passed(expiredTimerInfo.getExpiryTimeInMs())
        self.kept(held)
        yield framed(key[0], out, self.schema, self.key)

    def close(self) -> None:
        pass


class Planning(Timed):
    def __init__(self, key: str, planner: Planner, wait: int, interval: int, most: int, budget: int):
        super().__init__(key, PLANNED, ["at", "kind", "lead_id", "text"])
        self.how = (planner, wait, interval, most, budget)

    def fresh(self) -> Inbox:
        return Inbox(*self.how)

    def fields(self, machine: Inbox) -> dict:
        return {n: getattr(machine, n) for n in ("pending", "calls", "last", "now")}

    def machine(self) -> Inbox:
        held = super().machine()
        held.pending = [tuple(p) for p in held.pending]
        return held


class Claiming(Timed):
    def __init__(self, key: str, consumers: list[str], visibility: int, ttl: int):
        super().__init__(key, HELD, ["at", "kind", "consumer"])
        self.how = (consumers, visibility, ttl)

    def fresh(self) -> Job:
        return Job(*self.how)

    def fields(self, machine: Job) -> dict:
        return {n: getattr(machine, n) for n in ("state", "tried", "beat")}

    def gone(self, machine: Job) -> bool:
        return machine.state in ("", "expired")


def timed(events: DataFrame, key: str, processor: Timed, late: str) -> DataFrame:
    """The machine's rows over a stream of events with a time `at` in milliseconds. Timers fire as the watermark passes them."""
    clocked = events.withColumn("__at", F.timestamp_millis("at")).withWatermark("__at", late)
    return clocked.groupBy(key).transformWithStateInPandas(processor, f"`{key}` {dict(events.dtypes)[key]}, {processor.schema}", "Append", "EventTime")


def planned(events: DataFrame, key: str, planner: Planner, wait: int, interval: int, most: int = 40, budget: int = 10, late: str = "1 minute") -> DataFrame:
    return timed(events, key, Planning(key, planner, wait, interval, most, budget), late)


def held(events: DataFrame, key: str, consumers: list[str], visibility: int, ttl: int, late: str = "1 minute") -> DataFrame:
    return timed(events, key, Claiming(key, list(consumers), visibility, ttl), late)


class Versions(StatefulProcessor):
    """The facts of a claim as a map, its version, and the conclusions that stand as a list."""

    def __init__(self, claim: str):
        self.claim = claim

    def init(self, handle: Any) -> None:
        self.facts = handle.getMapState("facts", "fact string", "seq long")
        self.version = handle.getValueState("version", "n int")
        self.standing = handle.getListState("standing", "seq long, kind string, version int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.version.exists()
        version, out = self.version.get()[0] if known else 1, []
        every = pd.concat(list(rows)).sort_values("seq")
        for seq, kind, facts in every[["seq", "kind", "facts"]].itertuples(index=False):
            if kind in OVERTAKEN:
                self.standing.appendValue((int(seq), kind, version))
                out.append((seq, kind, version, "current"))
            if kind != "candidate":
                continue
            folded = {" ".join(f.split()).lower() for f in (facts if facts is not None else ()) if f and f.strip()}
            new = [f for f in sorted(folded) if not self.facts.containsKey((f,))]
            if new and known:
                version += 1
                out += [(s, k, v, OVERTAKEN[k]) for s, k, v in self.standing.get()]
                self.standing.clear()
            for f in new:
                self.facts.updateValue((f,), (int(seq),))
            known = True
            self.version.update((version,))
            out.append((seq, kind, version, None))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=[self.claim, "seq", "kind", "version", "status"])

    def close(self) -> None:
        pass


def evidence(events: DataFrame, claim: str) -> DataFrame:
    """Changes to `operators.evidence.versions` as a stream of events (claim, seq, kind, facts) that come in order of seq: a conclusion comes
    as current, and again when new facts overtake it; the last row of a (claim, seq) is its state."""
    kind = dict(events.dtypes)[claim]
    return events.groupBy(claim).transformWithStateInPandas(Versions(claim), f"`{claim}` {kind}, seq long, kind string, version long, status string", "Append", "None")
