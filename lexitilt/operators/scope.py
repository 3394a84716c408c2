"""Scope: which postings belong to the field of work, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexitilt.functions import fixed_values as fv
from lexitilt.functions.matching import matches, normal_key
from lexitilt.operators.shaping import as_metrics

IN_SCOPE = ["title_core", "title_leadership", "ambiguous_title_supported"]

SAMPLE_COLUMNS = ["job_id", "title", "company_name", "formatted_experience_level",
                  "industry_name", "scope_reason", "scope_exclusion_reason"]


def is_tech_industry(name: Column) -> Column:
    return matches(normal_key(name), fv.TECH_INDUSTRY_PATTERN)


def scope_rule(key: Column, description: Column, tech_industry: Column) -> Column:
    """The first rule that a posting meets, by name; the title as a normal key.

    CASE stops at the first match, so only ambiguous titles have their
    description searched.
    """
    supported = F.coalesce(tech_industry, F.lit(False)) | matches(
        normal_key(description), fv.TECH_DESCRIPTION_PATTERN)
    return (
        F.when(key == "", "missing_title")
        .when(matches(key, fv.NON_DIGITAL_ENGINEERING_PATTERN), "non_digital_engineering")
        .when(matches(key, fv.OFF_TARGET_ROLE_PATTERN), "off_target_business_role")
        .when(matches(key, fv.CORE_DIGITAL_TITLE_PATTERN), "title_core")
        .when(matches(key, fv.TECH_LEADERSHIP_TITLE_PATTERN), "title_leadership")
        .when(matches(key, fv.AMBIGUOUS_TECH_TITLE_PATTERN),
              F.when(supported, "ambiguous_title_supported")
              .otherwise("ambiguous_title_without_tech_context"))
        .otherwise("no_tech_scope_signal")
    )


def _with_text_rule(df: DataFrame) -> DataFrame:
    """Adds _scope_rule, the rule that title and description alone meet."""
    return (df.withColumn("_title", normal_key(F.col("title")))
            .withColumn("_scope_rule", scope_rule(
                F.col("_title"), F.col("description"), F.lit(False)))
            .drop("_title"))


def _decided(df: DataFrame, tech_col: str) -> DataFrame:
    """The decision from _scope_rule and the industry, which supports ambiguous titles."""
    unsupported = F.col("_scope_rule") == "ambiguous_title_without_tech_context"
    rule = F.when(unsupported & F.coalesce(tech_col, F.lit(False)), "ambiguous_title_supported") \
        .otherwise(F.col("_scope_rule"))
    included = F.col("_rule").isin(IN_SCOPE)
    return (
        df.withColumn("_rule", rule)
        .withColumns({
            "scope_include": included,
            "scope_reason": F.when(included | (F.col("_rule") == "missing_title"), F.col("_rule"))
            .otherwise("excluded"),
            "scope_exclusion_reason": F.when(included, "").otherwise(F.col("_rule")),
        })
        .drop("_rule", "_scope_rule")
    )


def classify_scope(df: DataFrame, tech_col: str = "is_tech_industry") -> DataFrame:
    """Adds scope_include, scope_reason and scope_exclusion_reason."""
    return _decided(_with_text_rule(df), tech_col)


def build_industry_lookup(job_industries: DataFrame, industries: DataFrame) -> DataFrame:
    """One row per job: any tech industry, and its first three industry names.

    The pattern runs once per industry, not once per posting, and repeated links
    are dropped before the join, so a job or industry with very many links
    reaches the shuffle as a few rows.
    """
    named = industries.select(
        "industry_id", "industry_name",
        is_tech_industry(F.col("industry_name")).alias("_tech"))
    links = job_industries.select("job_id", "industry_id").distinct()
    names = F.array_sort(F.collect_set("industry_name"))
    return (
        links.join(named, "industry_id", "left")
        .groupBy("job_id")
        .agg(F.coalesce(F.bool_or("_tech"), F.lit(False)).alias("is_tech_industry"),
             F.array_join(F.slice(names, 1, 3), " | ").alias("industry_name"))
    )


def apply_scope_filter(postings: DataFrame, lookup: DataFrame) -> DataFrame:
    """Industry context, scope decision and the broad tech-company flag.

    Titles and descriptions are matched before the join, so where only the decision is
    wanted, its rule crosses the shuffle and the text does not.
    """
    joined = (_with_text_rule(postings).join(lookup, "job_id", "left")
              .withColumn("is_tech_industry", F.coalesce("is_tech_industry", F.lit(False))))
    return (_decided(joined, "is_tech_industry")
            .withColumn("is_broad_tech_company", F.col("is_tech_industry")))


def core(scoped: DataFrame) -> DataFrame:
    return scoped.filter(F.col("scope_include"))


def broad(scoped: DataFrame) -> DataFrame:
    return scoped.filter(F.col("is_broad_tech_company"))


def scope_summary(scoped: DataFrame) -> DataFrame:
    return as_metrics(scoped.agg(
        F.count("*").alias("rows_total"),
        F.count_if("scope_include").alias("rows_in_scope"),
        F.count_if(~F.col("scope_include")).alias("rows_out_of_scope"),
        F.count_if("is_broad_tech_company").alias("broad_tech_company_rows"),
    ))


def scope_reasons(scoped: DataFrame) -> DataFrame:
    """How often each reason keeps or drops a posting."""
    return (scoped.groupBy("scope_include", "scope_reason", "scope_exclusion_reason")
            .agg(F.count("*").alias("rows")))


def top_industries(scoped: DataFrame, n: int = 10) -> DataFrame:
    name = F.coalesce(F.nullif("industry_name", F.lit("")), F.lit("Missing"))
    return (core(scoped).groupBy(name.alias("industry_name"))
            .agg(F.count("*").alias("rows"))
            .orderBy(F.desc("rows"), "industry_name").limit(n))


def sample_key(seed: int, key: Column) -> Column:
    """A reproducible shuffle position for a row."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def scope_audit_samples(scoped: DataFrame, n_per_bucket: int = 25, seed: int = 42) -> DataFrame:
    """Up to n kept and n dropped postings for review, told apart by scope_include."""
    columns = [c for c in SAMPLE_COLUMNS if c in scoped.columns]
    order = W.partitionBy("scope_include").orderBy(sample_key(seed, F.col("job_id")), "job_id")
    return (
        scoped.select("scope_include", *columns)
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= n_per_bucket).drop("_n")
        .withColumn("manual_precision_note", F.lit(""))
    )
