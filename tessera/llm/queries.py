"""The queries of this subpackage, by name: each takes (spark, sf_dir) and applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, collocations, cotraining, language, media, mixing, negatives, packing, rules, secrets, simhash, toxicity
from tessera.llm.common import crc_mod, table


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.one_source(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.format_chats(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, crc_mod("doc_id", 4) != 2)
    return language.predict(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document as `labels.quality` marks it, learned from rows whose crc32(doc_id as text) mod 5 isn't 0; predicted 1: keep."""
    docs = table(spark, sf_dir, "documents")
    pages = table(spark, sf_dir, "pages")
    model = cotraining.fit(docs, table(spark, sf_dir, "labels"), pages, crc_mod("doc_id", 5) != 0)
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return cotraining.score(docs, model, pages).select("doc_id", held_out, "text_score", "page_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among the images that media.rendered() makes of all embeddings, each with an edited copy."""
    return media.copies(media.rendered(table(spark, sf_dir, "embeddings")))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of rows whose vec_id is divisible by 7 are moved on by one first, so that some rows look like another label's."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.select("vec_id", moved.alias("label"), "embedding"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_chat": op2_chat,
    "op3_simhash": op3_simhash,
    "op4_toxicity": op4_toxicity,
    "op5_language": op5_language,
    "op6_secrets": op6_secrets,
    "op7_bpe": op7_bpe,
    "op8_cotraining": op8_cotraining,
    "op9_media": op9_media,
    "op10_rules": op10_rules,
    "op11_negatives": op11_negatives,
    "op12_collocations": op12_collocations,
    "op13_packing": op13_packing,
}
ORACLES: dict[str, str] = {"op6_secrets": secrets.oracle_sql(), "op11_negatives": negatives.ORACLE, "op12_collocations": collocations.ORACLE}
