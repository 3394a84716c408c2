"""Readers, writers and stage hand-over."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitilt.functions import fixed_values as fv
from lexitilt.sources import split_csv

_LONGS = {"job_id", "company_id", "sponsored", "listed_time", "original_listed_time",
          "expiry", "closed_time"}
_DOUBLES = {"remote_allowed", "min_salary", "med_salary", "max_salary", "views", "applies",
            "normalized_salary", "zip_code", "fips"}


def column_type(name: str) -> T.DataType:
    if name in _LONGS:
        return T.LongType()
    return T.DoubleType() if name in _DOUBLES else T.StringType()


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available: {df.columns}")
    return df


def input_order() -> Column:
    """A row's place in the files it is read from, as text that sorts like the input.

    Spark packs splits by size, so numbers given to rows as they are read do not follow the
    input from file to file; within one split they do. To be taken straight from a scan.
    """
    digits = lambda c: F.lpad(c.cast("string"), 20, "0")
    return F.concat_ws(":", F.col("_metadata.file_path"),
                       digits(F.col("_metadata.file_block_start")),
                       digits(F.monotonically_increasing_id()))


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
             nrows: int | None = None, order_col: str | None = None) -> DataFrame:
    """CSV with a header and quoted newlines; columns are taken by name.

    The header fixes the order of the columns, so it is read first (one row) and
    the typed schema is laid over it; no pass over the data infers types. Whole
    numbers may be written as 123.0, so ids are read as doubles and cast. A file is
    read by as many tasks as it has splits (see ``split_csv``); a first look at
    ``nrows`` rows reads no more of it than that, in one task.
    """
    options = dict(header=True, multiLine=True, escape='"', quote='"')
    header = spark.read.options(**options, inferSchema=False).csv(path).columns
    if nrows is None:
        df = split_csv.read(spark, path, header)
        digits = lambda c: F.lpad(F.col(f"_at.{c}").cast("string"), 20, "0")
        order = F.concat_ws(":", F.col("_at.file"), digits("range"), digits("place"))
    else:
        df = spark.read.options(**options).schema(
            T.StructType([T.StructField(c, T.StringType()) for c in header])).csv(path)
        order = input_order()
    wanted = list(columns) if columns else header
    require_columns(df, wanted)
    typed = []
    for name in wanted:
        kind = column_type(name)
        value = F.col(f"`{name}`")
        if isinstance(kind, T.LongType):
            value = F.coalesce(value.try_cast("bigint"),
                               value.try_cast("double").try_cast("bigint"))
        elif isinstance(kind, T.DoubleType):
            value = value.try_cast("double")
        typed.append(value.alias(name))
    df = df.select(*typed, *([order.alias(order_col)] if order_col else []))
    return df if nrows is None else df.limit(nrows)


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
               nrows: int | None = None, fmt: str | None = None,
               order_col: str | None = None) -> DataFrame:
    """Parquet by default, CSV by file name or on request.

    ``order_col`` names a column to add that tells the rows' order in the input. ``nrows``
    reads any so many rows in one task, for a first look.
    """
    fmt = fmt or ("csv" if str(path).rstrip("/").endswith(".csv") else "parquet")
    if fmt == "csv":
        return read_csv(spark, path, columns, nrows, order_col)
    df = spark.read.format(fmt).load(path)
    wanted = list(columns or df.columns)
    require_columns(df, wanted)
    df = df.select(*wanted, *([input_order().alias(order_col)] if order_col else []))
    return df if nrows is None else df.limit(nrows)


def load_postings(spark, path, columns=None, nrows=None, fmt=None) -> DataFrame:
    return read_table(spark, path, columns, nrows, fmt)


def load_job_industries(spark, path, nrows=None, fmt=None) -> DataFrame:
    df = read_table(spark, path, ["job_id", "industry_id"], nrows, fmt)
    return df.withColumn("industry_id", F.col("industry_id").try_cast("bigint"))


def load_industries(spark, path, nrows=None, fmt=None) -> DataFrame:
    df = read_table(spark, path, ["industry_id", "industry_name"], nrows, fmt)
    return df.withColumn("industry_id", F.col("industry_id").try_cast("bigint"))


def load_companies(spark, path, columns=("company_id",), nrows=None, fmt=None) -> DataFrame:
    return read_table(spark, path, columns, nrows, fmt)


def load_corpus(spark: SparkSession, path: str, text_col: str = "embedding_text",
                fmt: str | None = None) -> DataFrame:
    """A staged corpus: fails without the text column, missing text becomes empty."""
    df = require_columns(read_table(spark, path, fmt=fmt), [text_col])
    return df.withColumn(text_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: Sequence[str] = ()) -> str:
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.options(header=True, quote='"', escape='"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def export_group_corpora(labeled: DataFrame, path: str, *, kept_only: bool,
                         group_col: str = "seniority_final", fmt: str = "parquet") -> str:
    """One folder per seniority group, with or without duplicates."""
    df = labeled.filter(F.col("keep_for_model")) if kept_only else labeled
    df = df.filter(F.col(group_col).isin(fv.GROUP_ORDER))
    return write_table(df, path, fmt, partition_by=[group_col])



def save_vectors(vectors: DataFrame, name: str, path: str, buckets: int) -> str:
    """A table of vectors (with a column word) bucketed and sorted by word, under ``name`` in the
    session's catalogue and in the folder ``path``.

    A join on word reads it as it lies: its side is neither exchanged nor sorted.
    """
    (vectors.repartition(buckets, "word").write.bucketBy(buckets, "word").sortBy("word")
     .option("path", path).mode("overwrite").saveAsTable(name))
    return name


def lookup_vectors(spark: SparkSession, name: str, words: DataFrame) -> DataFrame:
    """The stored rows of ``words`` (word and any other columns), in every model."""
    return words.join(spark.table(name), "word")
