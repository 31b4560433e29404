"""The deterministic dry run: survey, signals, candidates, rejection and closure rounds, without a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import folds, rows

REASON = "dry run: a pattern matched; nothing was judged"


def signals(files: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """scope, file, line (from 1) and kind: the first line of a file for each class; a line is of the first class that it matches.

    files: scope, file, text. Texts without any match are left out before they are split."""
    any_of = "|".join(f"(?:{p})" for _, p in patterns)
    lines = files.filter(F.col("text").rlike(any_of)).select("scope", "file", F.posexplode(F.split("text", "\n")).alias("at", "content"))
    kind = F.when(F.lit(False), "")
    for name, pattern in patterns:
        kind = kind.when(F.col("content").rlike(pattern), name)
    return lines.withColumn("kind", kind).filter("kind is not null").groupBy("scope", "file", "kind").agg((F.min("at") + 1).alias("line"))


def candidates(found: DataFrame, per_scope: int) -> DataFrame:
    """The first signals of each scope, each rejected with the reason that it was never judged."""
    kept = rows.top_per(found, ["scope"], per_scope, F.col("file"), F.col("line"), F.col("kind"))
    return kept.withColumn("verdict", F.lit("rejected")).withColumn("reason", F.lit(REASON))


def run(files: DataFrame, patterns: list[tuple[str, str]], per_scope: int, max_rounds: int) -> DataFrame:
    """A row a scope: candidates, rejected, places, the rounds that it took, its state and findings (none). The first round sees every
    place anew, so scopes with candidates stay insufficient and go out again; the next round finds the same and closes them."""
    scopes = files.select("scope").distinct()
    own = candidates(signals(files, patterns), per_scope)
    told = own.groupBy("scope").agg(F.count("*").alias("candidates"), F.count_if(F.col("verdict") == "rejected").alias("rejected"), F.count_distinct("file", "line").alias("places"))
    same = scopes["scope"].eqNullSafe(told["scope"])
    now = scopes.join(told, same, "left").select(scopes["scope"], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("candidates", "rejected", "places")])
    now = now.withColumn("rounds", F.lit(0)).withColumn("state", F.lit("insufficient"))
    rules = folds.closure_rules(1)
    for round_no in range(max(1, max_rounds)):
        facts = now.withColumns({"gaps": F.lit(0), "covered": F.lit(True), "new_places": F.col("places") if round_no == 0 else F.lit(0), "unread": F.lit(0), "undecided": F.lit(0)})
        decision = F.when(F.lit(False), "")
        for name, rule in rules:
            decision = decision.when(rule, name)
        open_ = F.col("state") == "insufficient"
        closed = F.when(decision.isNull(), "sufficient").otherwise("insufficient")
        now = facts.select("scope", "candidates", "rejected", "places", F.when(open_, F.col("rounds") + 1).otherwise(F.col("rounds")).alias("rounds"), F.when(open_, closed).otherwise(F.col("state")).alias("state"))
    return now.withColumn("findings", F.lit(0).cast("long"))
