"""The training-data queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, langid, lines, mixing, quality, simhash, syncmers, tokens, toxicity
from .common import table


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op2_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_hierarchical_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(table(spark, sf_dir, "documents"))


def op5_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_report(table(spark, sf_dir, "documents"))


def op6_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.edited_counts(table(spark, sf_dir, "documents"))


def op7_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_typed_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_report(table(spark, sf_dir, "conversations"))


def op9_simhash_trie_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_syncmer_fingerprints, op2_bradley_terry_quality, op3_template_decontamination, op4_hierarchical_language_id, op5_fuzzy_line_dedup,
        op6_edit_aware_token_counts, op7_compression_toxicity, op8_typed_chat_format, op9_simhash_trie_dedup, op10_source_mix,
    ]
    return {f.__name__: f for f in found}
