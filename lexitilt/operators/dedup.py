"""Duplicate flags and keeping first copies, safe for groups of any size.

"First" needs an order, so every function takes ``row_id``: a column that is
unique and whose order is the input order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexitilt.functions import text as tx
from lexitilt.operators.shaping import as_metrics
from lexitilt.sources.staging import materialize

EXACT = "title_description_fingerprint"
TEMPLATE = "description_template_fingerprint"


def duplicate_flags(df: DataFrame, row_id: str = "job_id", *, staged: bool = False) -> DataFrame:
    """Per row: exact and template duplicate, group id, keep.

    No group is ever gathered: the first id and the size of each group come from
    a pre-aggregated count, and they go back to the rows by the unique row id, so
    the join is even however many copies a text has. The fingerprints are
    computed once: they are written to the shared folder as a narrow table, unless
    ``df`` is a saved table itself (``staged``), and both sides read that.
    """
    keys = df.select(row_id, EXACT, TEMPLATE)
    if not staged:
        keys = materialize(keys, "fingerprints")
    kinds = F.explode(F.array(
        F.struct(F.lit("exact").alias("kind"), F.col(EXACT).alias("fp")),
        F.struct(F.lit("template").alias("kind"), F.col(TEMPLATE).alias("fp"))))
    groups = (keys.select(row_id, kinds.alias("k"))
              .groupBy("k.kind", "k.fp")
              .agg(F.min(row_id).alias("_first"), F.count("*").alias("_copies")))
    firsts = (groups.groupBy(F.col("_first").alias(row_id))
              .agg(F.max(F.col("kind") == "exact").alias("_exact_first"),
                   F.max(F.col("kind") == "template").alias("_template_first"),
                   F.max(F.when(F.col("kind") == "template", F.col("_copies")))
                   .alias("_copies")))
    exact = ~F.coalesce("_exact_first", F.lit(False))
    template = ~F.coalesce("_template_first", F.lit(False))
    return (
        keys.join(firsts, row_id, "left")
        .select(
            row_id,
            exact.alias("is_exact_duplicate"),
            template.alias("is_template_duplicate"),
            F.when(template | (F.col("_copies") > 1), F.col(TEMPLATE)).otherwise("")
            .alias("duplicate_group_id"),
            (~exact & ~template).alias("keep_for_model"))
    )


def add_duplicate_flags(df: DataFrame, row_id: str = "job_id", *,
                        staged: bool = False) -> DataFrame:
    return df.join(duplicate_flags(df, row_id, staged=staged), row_id)


def prepare_text_corpus(df: DataFrame, row_id: str = "job_id", *,
                        nan_parity: bool = False) -> DataFrame:
    return add_duplicate_flags(tx.add_text_columns(df, nan_parity=nan_parity), row_id)


def keep_first(df: DataFrame, keys: list[str | Column], row_id: str = "job_id",
               copies: int = 1) -> DataFrame:
    """The first ``copies`` rows of each group, whole rows.

    Spark cuts each map task's output to that many rows per group before the
    shuffle, so a text with millions of copies is not gathered.
    """
    order = W.partitionBy(*keys).orderBy(row_id)
    return (df.withColumn("_n", F.row_number().over(order))
            .filter(F.col("_n") <= copies).drop("_n"))


def keep_for_model(df: DataFrame, row_id: str = "job_id") -> DataFrame:
    """The kept rows alone. A later exact copy is also a later template copy, so
    the first row of each template is what remains."""
    return keep_first(df, [TEMPLATE], row_id)


def capped_copies(df: DataFrame, text_col: str = "embedding_text",
                  group_col: str = "seniority", row_id: str = "job_id",
                  copies: int = 20) -> DataFrame:
    """At most ``copies`` rows per identical text inside each group; blank texts go."""
    # The test for blanks follows the window: ahead of it, it would be pushed to the
    # scan and work the text out twice. Blank texts are one group, cut like any other.
    blank = F.coalesce(F.col(text_col), F.lit("")) == ""
    kept = keep_first(df.withColumn("_blank", blank),
                      [F.col(group_col), F.sha2(F.col(text_col), 256)], row_id, copies)
    return kept.filter(~F.col("_blank")).drop("_blank")


def duplicate_summary(flags: DataFrame) -> DataFrame:
    return as_metrics(flags.agg(
        F.count("*").alias("rows_total"),
        F.count_if("keep_for_model").alias("rows_kept_for_model"),
        F.count_if("is_exact_duplicate").alias("exact_duplicates"),
        F.count_if("is_template_duplicate").alias("template_duplicates")))
