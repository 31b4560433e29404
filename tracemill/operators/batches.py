"""Answers about batches of claims: what counts, what rests on which evidence, and what runs again alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from . import rows


def verdicts(answers: DataFrame, members: DataFrame) -> DataFrame:
    """batch, claim, verdict, evidence_kind and status of the answers (batch, place, claim, verdict) about claims of their batch (members:
    batch, claim).

    An answer about another claim is passed over. Of repeated ones the first counts, even if it can't be read: status is decided,
    escalated (it asks for a trace) or unreadable. A batch has no trace, so what it decides is semantic."""
    own = answers.withColumn("claim", F.trim(F.coalesce("claim", F.lit("")))).filter("claim != ''").join(members.select("batch", "claim"), ["batch", "claim"], "left_semi")
    first = own.groupBy("batch", "claim").agg(F.min_by("verdict", "place").alias("raw"), F.min("place").alias("place"))
    word = F.lower(F.trim(F.coalesce("raw", F.lit(""))))
    status = F.when(word == "needs_dataflow", "escalated").when(word.isin(*fixed.VERDICTS), "decided").otherwise("unreadable")
    return first.select("batch", "claim", "place", F.when(status == "decided", word).alias("verdict"), F.when(status == "decided", "semantic").alias("evidence_kind"), status.alias("status"))


def again(verdicts: DataFrame, members: DataFrame, decided: DataFrame | None = None) -> DataFrame:
    """claim and turn (from 0) of the claims that run again alone: the escalated ones by batch and place, then those that have no verdict by
    batch and their place in it (members: batch, place, claim), each once. decided: claims that have one from elsewhere."""
    told = verdicts.filter("status = 'decided'").select("claim")
    if decided is not None:
        told = told.unionByName(decided.select("claim"))
    escalated = verdicts.filter("status = 'escalated'").select("claim", F.struct(F.lit(0).alias("kind"), "batch", "place").alias("at"))
    open_ = members.join(told, "claim", "left_anti").select("claim", F.struct(F.lit(1).alias("kind"), "batch", "place").alias("at"))
    once = escalated.unionByName(open_).groupBy("claim").agg(F.min("at").alias("at"))
    return rows.ordinal(once, "turn", F.col("at")).select("claim", "turn")


def single(answers: DataFrame, steps: DataFrame) -> DataFrame:
    """run, verdict, evidence_kind, noted and readable of answers (run, verdict, evidence_kind: the model's word) of runs of one claim. steps:
    run, place, tool, ok, error.

    The kind follows the run's last trace: dataflow where it has no error, else semantic, and noted where a trace failed or the model names
    one that isn't there. A verdict that isn't known isn't readable."""
    last = steps.filter("tool = 'dataflow_verify'").groupBy("run").agg(F.max_by(F.struct(F.col("ok"), F.col("error")), "place").alias("trace"))
    both = answers.join(last, "run", "left")
    usable = F.coalesce(F.col("trace.ok") & F.col("trace.error").isNull(), F.lit(False))
    word = F.lower(F.trim(F.coalesce("verdict", F.lit(""))))
    claimed = F.lower(F.trim(F.coalesce("evidence_kind", F.lit("")))) == "dataflow"
    return both.select("run", F.when(word.isin(*fixed.VERDICTS), word).alias("verdict"), F.when(usable, "dataflow").otherwise("semantic").alias("evidence_kind"), (~usable & (F.col("trace").isNotNull() | claimed)).alias("noted"), word.isin(*fixed.VERDICTS).alias("readable"))


def answered(paths: DataFrame, members: DataFrame) -> DataFrame:
    """The first attack path (batch, place, claim ...) of each claim of its batch; a claim without one stays without."""
    own = paths.join(members.select("batch", "claim"), ["batch", "claim"], "left_semi")
    return own.withColumn("__n", F.row_number().over(Window.partitionBy("batch", "claim").orderBy("place"))).filter("__n = 1").drop("__n")
