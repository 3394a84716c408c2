"""The registered query of each operator: production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexitilt.llm import (
    conversations,
    decontamination,
    language_id,
    licenses,
    merkle,
    mixing,
    near_dedup,
    pii,
    quality_classifier,
    quality_rules,
    repeats,
    toxicity,
    url_filter,
)
from lexitilt.llm.common import table

#: The key of the registered queries; a job passes its own secret.
PSEUDONYM_KEY = "registered-queries"


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, folder, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, folder, "pages"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "documents"))


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


def op7_pii_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return pii.mask(table(spark, folder, "documents"), PSEUDONYM_KEY)


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return toxicity.severity(documents, toxicity.train(documents, labels))


def op9_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken_words(table(spark, folder, "documents"))


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return quality_classifier.score(documents, quality_classifier.train(documents, labels))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verified_manifest(table(spark, folder, "documents"))


def op12_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.removed_repeats(table(spark, folder, "documents"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, folder, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality_rules,
        op2_benchmark_decontamination,
        op3_url_filter,
        op4_language_id,
        op5_license_scan,
        op6_simhash_near_dedup,
        op7_pii_pseudonyms,
        op8_toxicity,
        op9_source_mixing,
        op10_quality_classifier,
        op11_merkle_manifest,
        op12_repeated_bytes,
        op13_conversation_repair,
    )
}
