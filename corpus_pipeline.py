"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

Toxic documents go, one document of each near-duplicate group stays, personal data is replaced by its kind, rows are
repeated or left out as the mix of sources takes them, and texts are encoded and decoded. All but the last stage return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import common, mixing, pii, queries, simhash, toxicity, wordbpe
from tracemill.session import ship


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.one_of_each(docs, words=5, similarity=0.8)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pii.redacted(docs, pii.fit(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return wordbpe.encode_decode(docs, queries.tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", toxic), ("simhash", near_duplicates), ("pii", personal), ("mixing", mix), ("bpe", encode)]
#: SQL can't express the trained stages, hashes and tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
