"""A training corpus from documents: five stages, each one operator of the text subpackage.

A stage takes (spark, docs, folder) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitilt.llm import decontamination, mixing, near_dedup, pii, quality_classifier
from lexitilt.llm.common import shared_folder, table

PSEUDONYM_KEY = "corpus-pipeline"


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    classifier = quality_classifier.train(docs, table(spark, folder, "labels"))
    return quality_classifier.keep_good(docs, classifier)


def deduplicate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps one document of each group of linked SimHash fingerprints (four-word shingles, four bits)."""
    return near_dedup.keep_one_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontamination.decontaminated(docs, table(spark, folder, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Puts pseudonyms for personal data; an address may change its length, so n_chars follows."""
    made = pii.pseudonymised(docs, PSEUDONYM_KEY, kinds_as=None)
    length = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    return made.withColumn("n_chars", length).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The mixture: one row a block of words, with the documents it comes from."""
    return mixing.mixture(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("pii", pseudonymise),
    ("mixing", mix),
]

#: The stages hold models and hashes that SQL cannot express; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, folder, "documents")
    root = posixpath.join(shared_folder(spark), f"corpus-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        path = posixpath.join(root, f"{k}-{name}")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
