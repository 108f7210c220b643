"""The operators' queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from terracota.llm import base_sql, bpe, decontaminate, divergence, hard_negatives, langid, licenses, minhash, pii, quality_fm, quality_rules, secrets, simhash, url_model
from terracota.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_model.url_verdicts(table(spark, sf_dir, "pages"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of operator 1 that SQL can say: statistics and base rule."""
    docs = table(spark, sf_dir, "documents")
    return quality_rules.with_statistics(docs.select("doc_id", quality_rules.statistics(docs).alias("r")).select("doc_id", "r.*"))


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of operator 3 that SQL can say: its base kinds."""
    return op3_secret_scan(spark, sf_dir).drop("spans")


def personal_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of operator 7 that SQL can say: its base kinds."""
    return op7_personal_data(spark, sf_dir).drop("spans", "max_score")


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_decontamination, op3_secret_scan, op4_license_scan, op5_quality_classifier, op6_url_filter, op7_personal_data, op8_byte_bpe, op9_language_id, op10_simhash, op11_hard_negatives, op12_source_divergence, op13_minhash, quality_base, secret_base, personal_base)} | {"pipeline": corpus_pipeline.run}

ORACLES = {"op2_decontamination": decontaminate.ORACLE, "op6_url_filter": url_model.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE, "op12_source_divergence": divergence.ORACLE, "quality_base": base_sql.QUALITY, "secret_base": base_sql.SECRETS, "personal_base": base_sql.PERSONAL}
