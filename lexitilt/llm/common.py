"""Expressions and helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the control characters tab to carriage return.
SEPARATORS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SEPARATOR_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def blank_separated(text: Column) -> Column:
    """``text`` with every separator turned into a blank; empty for a null text.

    Plain replacements of single characters cost far less than one regular expression.
    """
    text = F.coalesce(text, F.lit(""))
    for c in SEPARATOR_CHARS[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def word_array(text: Column) -> Column:
    """The words of a text in order; none for a null text."""
    return F.array_remove(F.split(blank_separated(text), " "), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_of(key: Column, folds: int) -> Column:
    """A row's fold: the CRC-32 of its key as text, modulo ``folds``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share.

    It is the session's ``spark.checkpoint.dir``; a temporary one serves only a local session
    that names none.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut.

    Spark removes the files with the frame where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def released(df: DataFrame) -> DataFrame:
    """``df``, after a collection of the driver's garbage.

    Spark removes the shuffle files of steps that nothing can reach any more when the driver
    collects its garbage, which it may not do for long; an operator that has just written a step
    can so give back the disk of those that led to it. What Python let go of is told to the
    driver's JVM by another thread, hence the pauses.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.3)
        df.sparkSession.sparkContext._jvm.System.gc()
    return df


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` rows of ``df`` in the order of a seeded hash of ``key``.

    The same rows on every run; each map task keeps only its own first ``rows``.
    """
    order = F.xxhash64(F.lit(seed), F.col(key))
    return df.orderBy(order, F.col(key)).limit(rows)
