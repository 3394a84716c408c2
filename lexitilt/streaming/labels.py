"""The row-level stages on a stream of postings.

Scope, seniority and text rules keep no state, so they run on a streaming
DataFrame as they do on a table. Duplicates and corpus statistics look at the
whole corpus and stay batch steps over what the stream has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexitilt.functions.text import add_text_columns
from lexitilt.operators.scope import apply_scope_filter, core
from lexitilt.operators.seniority import apply_seniority_labels


def label_stream(postings: DataFrame, lookup: DataFrame) -> DataFrame:
    """In-scope postings with labels and text columns; ``lookup`` is a static table."""
    return add_text_columns(apply_seniority_labels(core(apply_scope_filter(postings, lookup))))


def write_labels(postings: DataFrame, lookup: DataFrame, path: str,
                 checkpoint: str) -> StreamingQuery:
    """Append labelled postings to parquet until the available input is used up."""
    return (label_stream(postings, lookup).writeStream.format("parquet")
            .option("path", path).option("checkpointLocation", checkpoint)
            .partitionBy("seniority_final").trigger(availableNow=True).start())
