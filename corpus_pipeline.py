"""Training-text pipeline: five stages over documents, each written to the shared folder and read again by the next.

language      drops documents without a learned language (null texts, texts without a letter)
near_copies   keeps one document, with the smallest id, of each group of near copies
benchmark     drops documents that benchmark passages contaminate
secrets       replaces every secret in the text by a mark, and n_chars by the new length where there was one
tokens        encodes every text; returns ids as packed 32-bit words, their count and digests of ids and decoded text

Stages but the last return the columns they are given. Each learns from, and works on, all that its predecessor kept.
SQL can't express the language, secret and token stages, so ORACLE_SQL is None; tests hold each stage against brute force.

Cases: documents with a null or empty text, or one without letters, go in the first stage; handed to a later stage, such rows pass
it: they are near copies of one another (one stays), clean, without secrets and encode as no ids. Rows are judged one by one, whatever
rows share their id, null ids too; of rows that repeat one stays. A very long text takes work in proportion to itself. Ties between
languages go to the first by name, between near copies to the smaller id. An empty table gives an empty result. Extra columns are
kept, whatever their names, until the last stage; n_chars may be missing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracota.llm import bpe, decontaminate, langid, secrets, simhash
from terracota.llm.common import table, unused, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = unused(docs, "lang_found")
    found = docs.withColumn(name, langid.predicted(docs, langid.learn(docs)))
    return found.where(F.col(f"{name}.lang_pred") != "und").drop(name)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = unused(docs, "new_text")
    found = docs.withColumn(name, secrets.redacted(docs))
    if "n_chars" in docs.columns:
        changed = ~F.col(name).eqNullSafe(F.col("text"))
        length = F.length(name).cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars")))
    return found.withColumn("text", F.col(name)).drop(name)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, packed=True)


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("secrets", without_secrets), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
