"""Profiling of a postings table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexitilt.functions import fixed_values as fv
from lexitilt.functions.matching import matches, strip
from lexitilt.operators.scope import sample_key
from lexitilt.operators.shaping import as_metrics
from lexitilt.sources.staging import materialize

# Timestamps in nanoseconds fit between these epoch milliseconds.
_MIN_MS, _MAX_MS = -9223372036854, 9223372036854

EXAMPLE_COLUMNS = ["job_id", "title", "company_name", "formatted_experience_level",
                   "formatted_work_type", "location", "description"]
NOISY_COLUMNS = ["job_id", "title", "company_name", "formatted_experience_level",
                 "description"]


def audit_summary(df: DataFrame, key: str = "job_id", text: str = "description") -> DataFrame:
    """Rows, columns, repeated keys and empty texts, as (metric, value)."""
    per_key = df.groupBy(key).agg(
        F.count("*").alias("n"),
        F.count_if(strip(F.col(text)) == "").alias("empty"))
    return as_metrics(per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.coalesce(F.sum("n") - F.count("*"), F.lit(0)).alias("duplicate_job_id_count"),
        F.coalesce(F.sum("empty"), F.lit(0)).alias("description_empty_count")))


def _date_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One pass over the table, then one row per date column."""
    columns = [c for c in columns if c in df.columns]
    ms = {c: F.col(c).cast("bigint") for c in columns}
    in_range = {c: F.when(m.between(_MIN_MS, _MAX_MS), m) for c, m in ms.items()}
    wide = df.agg(F.count("*").alias("_rows"), *[a for c in columns for a in (
        F.count(in_range[c]).alias(f"{c}_n"), F.min(in_range[c]).alias(f"{c}_lo"),
        F.max(in_range[c]).alias(f"{c}_hi"))])
    rows = F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"{c}_n").alias("non_null"),
        F.timestamp_millis(F.col(f"{c}_lo")).alias("min"),
        F.timestamp_millis(F.col(f"{c}_hi")).alias("max")) for c in columns]))
    return wide.select("_rows", rows.alias("r")).select("r.*", "_rows")


def date_coverage(df: DataFrame, columns: Sequence[str] = tuple(fv.DATE_COLUMNS)) -> DataFrame:
    """Non-null count, first and last time of each epoch-millisecond column."""
    return _date_rows(df, columns).drop("_rows")


def text_length_quantiles(df: DataFrame, text: str = "description",
                          quantiles: Sequence[float] = tuple(fv.TEXT_LENGTH_QUANTILES),
                          ) -> DataFrame:
    """Exact quantiles with linear interpolation.

    Lengths are counted first, so the quantile sees one row per distinct length.
    """
    lengths = (df.groupBy(F.length(F.coalesce(text, F.lit(""))).alias("length"))
               .agg(F.count("*").alias("n")))
    levels = F.array(*[F.lit(q) for q in quantiles])
    return (lengths.agg(F.percentile("length", levels, F.col("n")).alias("v"))
            .select(F.posexplode("v").alias("i", "description_length"))
            .select(F.get(levels, F.col("i")).alias("quantile"), "description_length"))


def null_rates(df: DataFrame) -> DataFrame:
    """Percentage of missing cells per column, highest first; one pass."""
    wide = df.agg(*[(F.avg(F.col(f"`{c}`").isNull().cast("int")) * 100).alias(c)
                    for c in df.columns])
    return (wide.unpivot([], wide.columns, "column", "null_pct")
            .orderBy(F.desc("null_pct"), "column"))


def top_null_rates(df: DataFrame, n: int = 12) -> DataFrame:
    return null_rates(df).limit(n)


def key_coverage(df: DataFrame, key: str, other: DataFrame, name: str) -> DataFrame:
    """Rows whose key occurs in another table, and all rows.

    Rows are counted per key before the join, so a key shared by very many rows
    is one row in it.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    known = (other.select(key).filter(F.col(key).isNotNull()).distinct()
             .withColumn("_known", F.lit(True)))
    return (counts.join(known, key, "left")
            .agg(F.coalesce(F.sum(F.when(F.col("_known"), F.col("n"))), F.lit(0))
                 .alias("matched_rows"),
                 F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"))
            .select(F.lit(name).alias("join"), "matched_rows", "total_rows"))


def join_coverage(postings: DataFrame, companies: DataFrame,
                  job_industries: DataFrame) -> DataFrame:
    return (key_coverage(postings, "company_id", companies, "companies")
            .unionByName(key_coverage(postings, "job_id", job_industries, "job_industries")))


def match_rates(coverage: DataFrame) -> DataFrame:
    return coverage.withColumn(
        "match_rate", F.try_divide(F.col("matched_rows") * 100.0, F.col("total_rows")))


def date_spans(postings: DataFrame,
               columns: Sequence[str] = tuple(fv.DATE_COLUMNS)) -> DataFrame:
    """Date coverage with the share of rows dated and the span in days."""
    micros = F.unix_micros("max") - F.unix_micros("min")
    return (_date_rows(postings, columns)
            .withColumns({
                "coverage_pct": F.try_divide(F.col("non_null") * 100.0, F.col("_rows")),
                "span_days": micros / F.lit(86400e6)})
            .drop("_rows"))


def level_distribution(df: DataFrame, level: str = "formatted_experience_level") -> DataFrame:
    return (df.groupBy(F.coalesce(level, F.lit("MISSING")).alias("level"))
            .agg(F.count("*").alias("count"))
            .orderBy(F.desc("count"), "level"))


def sample_by_level(df: DataFrame, n_per_level: int = 5, seed: int = 42,
                    level: str = "formatted_experience_level",
                    key: str = "job_id") -> DataFrame:
    """Up to n rows per level in a seeded hash order."""
    columns = [c for c in EXAMPLE_COLUMNS if c in df.columns]
    order = W.partitionBy("experience_bucket").orderBy(sample_key(seed, F.col(key)), key)
    return (df.select(*columns, F.coalesce(level, F.lit("MISSING")).alias("experience_bucket"))
            .withColumn("_n", F.row_number().over(order))
            .filter(F.col("_n") <= n_per_level).drop("_n"))


def noisy_examples(df: DataFrame, n_per_bucket: int = 10, row_id: str = "job_id",
                   level: str = "formatted_experience_level") -> DataFrame:
    """The first n titles that contradict their level, per kind of contradiction.

    One pass: a row is copied into each bucket it belongs to.
    """
    columns = [c for c in NOISY_COLUMNS if c in df.columns]
    buckets = [
        F.when(matches(F.col("title"), pattern, ignore_case=True)
               & ~F.coalesce(F.col(level).isin(levels), F.lit(False)), name)
        for name, (pattern, levels) in fv.NOISY_BUCKETS.items()]
    order = W.partitionBy("noise_bucket").orderBy("_order")
    return (df.select(*columns, F.col(row_id).alias("_order"),
                      F.explode(F.array_compact(F.array(*buckets))).alias("noise_bucket"))
            .withColumn("_n", F.row_number().over(order))
            .filter(F.col("_n") <= n_per_bucket).drop("_n", "_order"))


# The whole audit on one reading of the input

_COUNTED = ("job_id", "company_id")


def observed(postings: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, Observation]:
    """``postings`` and what Spark sees of it while it is written: rows, missing cells of
    ``columns``, empty texts, and count, first and last of each date."""
    seen = Observation("audit")
    dates = [c for c in fv.DATE_COLUMNS if c in columns]
    ms = {c: F.col(c).cast("bigint") for c in dates}
    in_range = {c: F.when(m.between(_MIN_MS, _MAX_MS), m) for c, m in ms.items()}
    metrics = [F.count(F.lit(1)).alias("rows"),
               F.count_if(strip(F.col("description")) == "").alias("empty"),
               *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"null {c}") for c in columns],
               *[a for c in dates for a in (
                   F.count(in_range[c]).alias(f"n {c}"), F.min(in_range[c]).alias(f"lo {c}"),
                   F.max(in_range[c]).alias(f"hi {c}"))]]
    return postings.observe(seen, *metrics), seen


def value_counts(postings: DataFrame) -> DataFrame:
    """(kind, value, n): how often each key, text length and level occurs, in one pass.

    Values are text; a missing one is a value of its own.
    """
    length = F.length(F.coalesce("description", F.lit("")))
    kinds = {**{c: F.col(c) for c in _COUNTED}, "length": length,
             "level": F.coalesce("formatted_experience_level", F.lit("MISSING"))}
    rows = F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in kinds.items()]))
    return postings.select(rows.alias("r")).groupBy("r.kind", "r.value").agg(
        F.count("*").alias("n"))


def _coverage(counts: DataFrame, key: str, other: DataFrame, name: str) -> DataFrame:
    own = counts.filter(F.col("kind") == key).select(F.col("value").cast("bigint").alias(key), "n")
    known = (other.select(key).filter(F.col(key).isNotNull()).distinct()
             .withColumn("_known", F.lit(True)))
    return (own.join(known, key, "left")
            .agg(F.coalesce(F.sum(F.when(F.col("_known"), F.col("n"))), F.lit(0)).alias("matched_rows"),
                 F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"))
            .select(F.lit(name).alias("join"), "matched_rows", "total_rows"))


def audit_tables(postings: DataFrame, columns: Sequence[str], seen: dict, companies: DataFrame,
                 job_industries: DataFrame, row_id: str = "job_id") -> dict[str, DataFrame]:
    """The audit of a written table ``postings``, of which ``seen`` was observed as it was written.

    What was observed is not counted again; keys, lengths and levels are counted in one pass, and
    the samples read their columns. ``row_id`` gives the order of the input.
    """
    spark = postings.sparkSession
    counts = materialize(value_counts(postings), "counts")
    ids = counts.filter(F.col("kind") == "job_id").agg(
        F.coalesce(F.sum("n") - F.count("*"), F.lit(0)).alias("duplicate_job_id_count"))
    summary = as_metrics(ids.select(
        F.lit(seen["rows"]).cast("bigint").alias("rows"),
        F.lit(len(columns)).cast("bigint").alias("columns"), "duplicate_job_id_count",
        F.lit(seen["empty"]).cast("bigint").alias("description_empty_count")))
    rates = spark.createDataFrame(
        [(c, 100.0 * seen[f"null {c}"] / seen["rows"] if seen["rows"] else None) for c in columns],
        "column string, null_pct double").orderBy(F.desc("null_pct"), "column")
    dates = spark.createDataFrame(
        [(c, seen[f"n {c}"], seen[f"lo {c}"], seen[f"hi {c}"]) for c in fv.DATE_COLUMNS if c in columns],
        "column string, non_null long, lo long, hi long").select(
        "column", "non_null", F.timestamp_millis("lo").alias("min"), F.timestamp_millis("hi").alias("max"))
    levels = F.array(*[F.lit(q) for q in fv.TEXT_LENGTH_QUANTILES])
    quantiles = (counts.filter(F.col("kind") == "length")
                 .agg(F.percentile(F.col("value").cast("int"), levels, F.col("n")).alias("v"))
                 .select(F.posexplode("v").alias("i", "description_length"))
                 .select(F.get(levels, F.col("i")).alias("quantile"), "description_length"))
    return {
        "audit_summary": summary,
        "null_rates": rates,
        "date_coverage": dates,
        "text_length_summary": quantiles,
        "join_coverage": _coverage(counts, "company_id", companies, "companies").unionByName(
            _coverage(counts, "job_id", job_industries, "job_industries")),
        "experience_examples": sample_by_level(postings),
        "noisy_label_examples": noisy_examples(postings, row_id=row_id),
        "experience_level_distribution": (
            counts.filter(F.col("kind") == "level")
            .select(F.col("value").alias("level"), F.col("n").alias("count"))
            .orderBy(F.desc("count"), "level")),
    }
