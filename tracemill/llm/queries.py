"""The queries opN_<name>: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, convrepair, digest, interactions, langmask, media, mixing, pii, simhash, tokenbin, tokencount, toxicity, urlrules, wordbpe


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    rows = pii.found(docs, pii.fit(docs))
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op2_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprinted(common.table(spark, sf_dir, "documents"))


def op3_token_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.read(tokenbin.write(common.table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(common.table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), limit=4096)


def op5_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op6_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(common.table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict", "template")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.encode_decode(common.table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), digests=True)


def op9_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select("doc_id", (toxicity.fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_media_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.placed(common.table(spark, sf_dir, "documents")))


def op11_language_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    rows = langmask.identified(docs, langmask.fit(docs))
    return rows.select("doc_id", (toxicity.fold() == 0).alias("held_out"), "lang_pred", "score")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = common.table(spark, sf_dir, "conversations")
    rows = convrepair.audited(convrepair.damaged(conversations), conversations)
    return rows.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.interactions(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_skip_chain_pii": op1_skip_chain_pii,
    "op2_canonical_digest": op2_canonical_digest,
    "op3_token_bits": op3_token_bits,
    "op4_token_counts": op4_token_counts,
    "op5_pivotal_mix": op5_pivotal_mix,
    "op6_url_templates": op6_url_templates,
    "op7_simhash": op7_simhash,
    "op8_word_bpe": op8_word_bpe,
    "op9_toxicity_cnn": op9_toxicity_cnn,
    "op10_media_shards": op10_media_shards,
    "op11_language_masks": op11_language_masks,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_filter_interactions": op13_filter_interactions,
}
ORACLE_SQL: dict[str, str] = {"op13_filter_interactions": interactions.SQL}
