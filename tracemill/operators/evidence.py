"""Versions of evidence: new facts about a claim retract what was concluded before.

A claim's candidates bring facts. The first candidate makes version 1; a later one with a fact that the claim hasn't (case and white
space folded) makes the next version: verdicts and attack paths so far become history and findings so far are retracted.
`streaming.evidence` keeps the same as a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rows
from .store import materialised

#: What becomes of a conclusion that new facts overtake.
OVERTAKEN = {"verdict": "history", "path": "history", "finding": "retracted"}


def fact(text: Column) -> Column:
    """A fact as it is compared."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def versions(events: DataFrame, claim: str) -> DataFrame:
    """claim, seq, kind, version (1 from the first candidate on) and status (current, history or retracted; null for candidates) of
    the events of each claim.

    events: claim, seq (a number that orders a claim's events), kind (candidate, verdict, path or finding), facts (array of texts,
    of candidates). The fact sets' epochs are found by each fact's first event, so a claim's events needn't meet in one task;
    running numbers come from ranges (`rows.running`). Blank facts are none; a claim without candidates has version 1."""
    base = materialised(events.select(claim, "seq", "kind", "facts"))
    candidates = base.filter("kind = 'candidate'")
    begins = candidates.groupBy(claim).agg(F.min("seq").alias("__begin"))
    each = candidates.select(claim, "seq", F.explode("facts").alias("__fact")).select(claim, "seq", fact(F.col("__fact")).alias("__fact")).filter("__fact != ''")
    bumps = each.groupBy(claim, "__fact").agg(F.min("seq").alias("seq")).select(claim, "seq").distinct()
    bumps = bumps.join(begins, claim).filter("seq > __begin").select(claim, "seq", F.lit(1).alias("__bump"))
    marked = base.drop("facts").join(bumps, [claim, "seq"], "left")
    counted = rows.running(marked, [claim], ["seq"], F.coalesce("__bump", F.lit(0)), "version")
    last = bumps.groupBy(claim).agg((F.count("*") + 1).alias("__last"))
    told = counted.withColumn("version", F.col("version") + 1).join(last, claim, "left")
    gone = F.lit(None).cast("string")
    for kind, word in OVERTAKEN.items():
        gone = F.when(F.col("kind") == kind, word).otherwise(gone)
    status = F.when(F.col("kind") == "candidate", None).when(F.col("version") < F.coalesce("__last", F.lit(1)), gone).otherwise("current")
    return told.select(claim, "seq", "kind", "version", status.alias("status"))


def state(versions: DataFrame, claim: str) -> DataFrame:
    """Per claim its version and how many verdicts, paths and findings are current, history or retracted."""
    n = [F.count_if((F.col("kind") == kind) & (F.col("status") == status)).alias(f"{status}_{kind}s") for kind, gone in OVERTAKEN.items() for status in ("current", gone)]
    return versions.groupBy(claim).agg(F.max("version").alias("version"), *n)
