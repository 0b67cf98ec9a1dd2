"""A corpus pipeline: toxicity filter, near-duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. run() writes each stage's result to the
shared folder and reads it back, so a lost executor repeats one stage's tasks at most.

In every stage a null text counts as empty, nulls in other columns are values like others, an empty table gives an empty
one, and texts are read whole, however long. Columns beyond those of documents go along, whatever their names (maps aside,
which can't be compared). Repeated rows stay as many, but for near-duplicates, where they are one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, secrets, simhash, toxicity
from tessera.llm.common import crc_mod, table
from tessera.plans.shared import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores under 0.5; it learns from the labels of the rows that op4 learns from. Without any label all stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    scored, score = toxicity.flag(docs, model)
    return scored.where(F.col(score) < 0.5).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest key, nulls last; ties by a hash of the whole row."""
    return simhash.deduplicate(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark, and n_chars follows."""
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; a null source is a source."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and both digests of the round trip."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean),
    ("near_duplicates", distinct),
    ("secrets", redacted),
    ("mixing", mixed),
    ("tokens", tokens),
]
#: SQL can express neither the trees nor the fingerprints.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
