"""Coded-word rates per group, and how they hold across corpus variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitilt.functions import fixed_values as fv
from lexitilt.functions.text import letter_tokens, whitespace_tokens
from lexitilt.operators.shaping import as_metrics, in_group_order


def labeled_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("seniority_source") == "linkedin_primary")


def listed_count(tokens: Column, words: Sequence[str]) -> Column:
    """How many tokens, repeats included, are in a word list."""
    return F.size(F.filter(tokens, lambda t: t.isin(list(words)))).cast("bigint")


def coded_counts(df: DataFrame, tokens: Column,
                 masculine: Sequence[str] = tuple(fv.MASCULINE_CODED_WORDS),
                 feminine: Sequence[str] = tuple(fv.FEMININE_CODED_WORDS)) -> DataFrame:
    """Adds masculine, feminine and total token counts to each row."""
    return (df.withColumn("_tokens", tokens)
            .withColumns({
                "masculine_count": listed_count(F.col("_tokens"), masculine),
                "feminine_count": listed_count(F.col("_tokens"), feminine),
                "token_total": F.size("_tokens").cast("bigint")})
            .drop("_tokens"))


def with_rates(summary: DataFrame) -> DataFrame:
    """Counts per 1000 tokens and their difference; NULL without tokens."""
    def rate(n: str) -> Column:
        return F.try_divide(F.col(n).cast("double"), F.col("token_total")) * 1000

    return (summary.withColumns({"masculine_per_1000": rate("masculine_count"),
                                 "feminine_per_1000": rate("feminine_count")})
            .withColumn("bias_score", F.col("masculine_per_1000") - F.col("feminine_per_1000")))


COUNTS = ["masculine_count", "feminine_count", "token_total"]


def bias_from_counts(counted: DataFrame, keys: Sequence[str] = ("group",)) -> DataFrame:
    return with_rates(counted.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS]))


def lexicon_bias(df: DataFrame, text_col: str = "model_text",
                 group_col: str = "seniority_final") -> DataFrame:
    """Coded-word counts and rates per group."""
    counted = coded_counts(
        df.filter(F.col(group_col).isNotNull()).select(
            F.col(group_col).alias("group"), F.col(text_col)),
        whitespace_tokens(F.col(text_col)))
    return bias_from_counts(counted)


def lexicon_bias_synthetic(df: DataFrame, text_col: str = "embedding_text",
                           group_col: str = "seniority") -> DataFrame:
    """The same with the longer lists and the letters-only tokeniser."""
    counted = coded_counts(
        df.filter(F.col(group_col).isNotNull()).select(
            F.col(group_col).alias("group"), F.col(text_col)),
        letter_tokens(F.col(text_col)),
        fv.MASCULINE_CODED_WORDS_LONG, fv.FEMININE_CODED_WORDS_LONG)
    return bias_from_counts(counted)


def lexicon_variants(counted: DataFrame) -> DataFrame:
    """Rates for three corpora in one pass: deduped, labeled-only deduped, all rows.

    Needs group, the three counts, seniority_source and keep_for_model.
    """
    keep = F.col("keep_for_model")
    variants = F.array_compact(F.array(
        F.lit("nondedup"),
        F.when(keep, "labeled_plus_backfilled"),
        F.when(keep & (F.col("seniority_source") == "linkedin_primary"), "labeled_only")))
    return bias_from_counts(
        counted.select("group", *COUNTS, F.explode(variants).alias("variant")),
        ("variant", "group"))


def scope_benchmark(scoped: DataFrame) -> DataFrame:
    """Rows of the broad slice next to the core."""
    return as_metrics(scoped.agg(
        F.count_if("is_broad_tech_company").alias("broad_tech_company_rows"),
        F.count_if("scope_include").alias("digital_tech_rows")))


def tagged_union(tables: dict[str, DataFrame], tag: str = "variant") -> DataFrame:
    frames = [df.withColumn(tag, F.lit(name)) for name, df in tables.items()]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def compare_effects(summaries: DataFrame, variants: Sequence[str]) -> DataFrame:
    """Mean effect of each variant side by side, every group kept in order."""
    wide = summaries.groupBy("group").agg(*[
        F.max(F.when(F.col("variant") == v, F.col("effect_size_mean"))).alias(v)
        for v in variants])
    return in_group_order(wide)
