"""Seniority labels: by title and platform level, and by title, text and experience."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexitilt.functions import fixed_values as fv
from lexitilt.functions.matching import lookup, matches, normal_key, strip
from lexitilt.operators.shaping import in_group_order, small_table

REVIEW_COLUMNS = ["job_id", "title", "raw_experience_level", "seniority_final",
                  "seniority_rule", "company_name"]
SOURCES = ["linkedin_primary", "title_backfill", "title_override"]


def collapse_level(level: Column) -> Column:
    """Platform level to group; exact match apart from surrounding whitespace."""
    return lookup(strip(level), fv.LEVEL_TO_SENIORITY)


def title_signal(key: Column) -> Column:
    """Group that a title speaks for, if any; the title as a normal key."""
    return (F.when(matches(key, fv.ENTRY_TITLE_PATTERN), "entry")
            .when(matches(key, fv.LEADERSHIP_TITLE_PATTERN), "leadership")
            .when(matches(key, fv.SENIOR_TITLE_PATTERN), "senior"))


def apply_seniority_labels(df: DataFrame) -> DataFrame:
    """A title signal wins over the platform level, which wins over the default."""
    signal, level = F.col("_signal"), F.col("_level")
    return (
        df.withColumn("_title", normal_key(F.col("title")))
        .withColumns({
            "_signal": title_signal(F.col("_title")),
            "_level": collapse_level(F.col("formatted_experience_level")),
        })
        .withColumns({
            "raw_experience_level": F.col("formatted_experience_level"),
            "seniority_final": F.coalesce(signal, level, F.lit("mid")),
            "seniority_source":
                F.when(signal.isNull() & level.isNotNull(), "linkedin_primary")
                .when(signal != level, "title_override")
                .otherwise("title_backfill"),
            "seniority_rule":
                F.when(signal.isNotNull(), F.concat(signal, F.lit("_title_signal")))
                .when(level.isNotNull(), "linkedin_experience_level")
                .otherwise("default_mid_backfill"),
        })
        .drop("_title", "_signal", "_level")
    )


def override_review(labeled: DataFrame) -> DataFrame:
    return (labeled.filter(F.col("seniority_source") == "title_override")
            .select([c for c in REVIEW_COLUMNS if c in labeled.columns]))


def source_counts(labeled: DataFrame) -> DataFrame:
    return (labeled.groupBy("seniority_final", "seniority_source")
            .agg(F.count("*").alias("rows")))


def source_pivot(labeled: DataFrame) -> DataFrame:
    """Group by source, zeros filled, in group order."""
    wide = labeled.groupBy(F.col("seniority_final").alias("group")).agg(*[
        F.count_if(F.col("seniority_source") == s).alias(s) for s in SOURCES])
    return in_group_order(wide).na.fill(0)


def final_distribution(labeled: DataFrame, group_col: str = "seniority_final") -> DataFrame:
    counts = (labeled.groupBy(F.col(group_col).alias("group"))
              .agg(F.count("*").alias("rows")))
    return in_group_order(counts).na.fill(0)


def keep_pivot(labeled: DataFrame) -> DataFrame:
    wide = labeled.groupBy(F.col("seniority_final").alias("group")).agg(
        F.count_if("keep_for_model").alias("kept"),
        F.count_if(~F.col("keep_for_model")).alias("dropped"))
    return in_group_order(wide).na.fill(0)


# Synthetic postings

def parse_experience(experience: Column) -> Column:
    """Struct of lowest and highest years and their span; NULLs without a number."""
    key = F.lower(strip(experience))

    def number(pattern: str, part: int) -> Column:
        return F.nullif(F.regexp_extract(key, "(?iU)" + pattern, part),
                        F.lit("")).try_cast("bigint")

    low = number(fv.EXPERIENCE_RANGE_PATTERN, 1)
    high = number(fv.EXPERIENCE_RANGE_PATTERN, 2)
    single = number(fv.EXPERIENCE_SINGLE_PATTERN, 1)
    lo, hi = F.coalesce(low, single), F.coalesce(high, single)
    return F.struct(lo.alias("lo"), hi.alias("hi"), (hi - lo).alias("span"))


def degree_level(qualification: Column) -> Column:
    key = F.replace(normal_key(qualification), F.lit(" "), F.lit(""))
    return lookup(key, fv.DEGREE_LEVELS)


def is_data_research_title(title: Column) -> Column:
    return matches(normal_key(title), fv.DATA_RESEARCH_TITLE_PATTERN)


def is_tech_title(title: Column) -> Column:
    key = normal_key(title)
    return (matches(key, fv.TECH_TITLE_INCLUDE_PATTERN)
            & ~matches(key, fv.TECH_TITLE_EXCLUDE_PATTERN))


def hybrid_seniority(title: Column, clean_text: Column, lo: Column) -> Column:
    """Entry, then confirmed leadership, then senior, else mid.

    Title and text are normal keys (lower case, stripped). ``lo`` is the lowest years of ``parse_experience``. Comparisons with a NULL
    ``lo`` are not true, so their branches do not apply. Title tests stand before
    text tests: they are cheaper and settle most rows.
    """
    t, text = title, clean_text
    leads = (matches(t, fv.EXEC_TITLE_PATTERN) | matches(t, fv.DIRECTOR_PATTERN)
             | matches(t, fv.ARCHITECT_PATTERN) | matches(text, fv.MANAGER_PATTERN)
             | matches(text, fv.LEADERSHIP_DUTY_PATTERN))
    senior = (matches(t, fv.SENIOR_MARK_PATTERN) | F.coalesce(lo >= 5, F.lit(False))
              | matches(text, fv.SENIOR_DUTY_PATTERN) | matches(text, fv.SENIOR_MARK_PATTERN))
    return (F.when(F.coalesce(lo <= 1, F.lit(False)) | matches(t, fv.EARLY_CAREER_PATTERN),
                   "entry")
            .when((lo >= 2) & leads, "leadership")
            .when(senior, "senior")
            .otherwise("mid"))


def seniority_score(title: Column, clean_text: Column, lo: Column, degree: Column) -> Column:
    t, text = title, clean_text

    def points(test: Column, value: float) -> Column:
        return F.when(test, value).otherwise(0.0)

    years = reduce(lambda case, step: case.when(lo >= step[0], step[1]),
                   fv.SCORE_YEARS[1:], F.when(lo >= fv.SCORE_YEARS[0][0], fv.SCORE_YEARS[0][1]))
    terms = [
        points(matches(t, fv.SENIOR_MARK_PATTERN), fv.SCORE_TITLE_SENIOR),
        points(matches(t, fv.MANAGER_PATTERN), fv.SCORE_TITLE_MANAGER),
        points(matches(text, fv.SENIOR_DUTY_PATTERN), fv.SCORE_TEXT_DUTY),
        points(matches(text, fv.SENIOR_MARK_PATTERN), fv.SCORE_TEXT_SENIOR),
        points(matches(text, fv.MANAGER_PATTERN), fv.SCORE_TEXT_MANAGER),
        points(matches(text, fv.EARLY_CAREER_PATTERN), fv.SCORE_TEXT_EARLY),
        years.otherwise(0.0),
        *[points(F.coalesce(degree == d, F.lit(False)), p) for d, p in fv.SCORE_DEGREES.items()],
    ]
    return reduce(lambda a, b: a + b, terms)


def scored_seniority(title: Column, clean_text: Column, lo: Column, hi: Column,
                     degree: Column) -> Column:
    """Hard rules first, then points for title, text, experience and degree.

    Title and text are normal keys (lower case, stripped).
    """
    t = title
    lowered = matches(t, fv.LOWERING_PATTERN)
    score = seniority_score(title, clean_text, lo, degree)
    return (F.when(matches(t, fv.EXEC_TITLE_PATTERN) & ~lowered, "leadership")
            .when((lo >= 8) & matches(t, fv.DIRECTOR_PATTERN), "leadership")
            .when(matches(t, fv.EARLY_CAREER_PATTERN), "entry")
            .when(hi <= 1, "entry")
            .when(lowered & matches(t, fv.MANAGER_PATTERN), "mid")
            .when(score >= fv.SCORE_SENIOR_FROM, "senior")
            .when(score <= fv.SCORE_ENTRY_UPTO, "entry")
            .otherwise("mid"))


def _with_keys(df: DataFrame) -> DataFrame:
    """Normal keys and parsed years as columns, so each is worked out once per row."""
    return df.withColumns({
        "_title": normal_key(F.col("title")),
        "_text": normal_key(F.col("clean_text")),
        "_years": parse_experience(F.col("experience")),
    })


def add_hybrid_seniority(df: DataFrame, out: str = "seniority") -> DataFrame:
    return (_with_keys(df)
            .withColumn(out, hybrid_seniority(
                F.col("_title"), F.col("_text"), F.col("_years.lo")))
            .drop("_title", "_text", "_years"))


def add_scored_seniority(df: DataFrame, out: str = "seniority") -> DataFrame:
    return (_with_keys(df)
            .withColumn(out, scored_seniority(
                F.col("_title"), F.col("_text"), F.col("_years.lo"), F.col("_years.hi"),
                degree_level(F.col("qualifications"))))
            .drop("_title", "_text", "_years"))


def tech_subset(df: DataFrame) -> DataFrame:
    return df.filter(is_tech_title(F.col("title")))


def tech_share(df: DataFrame) -> DataFrame:
    """Rows in all, tech rows and their percentage."""
    return (df.agg(F.count("*").alias("rows_total"),
                   F.count_if(is_tech_title(F.col("title"))).alias("rows_tech"))
            .withColumn("pct_tech", F.round(F.try_divide(
                100.0 * F.col("rows_tech"), F.col("rows_total")), 2)))


def distribution(df: DataFrame, group_col: str = "seniority") -> DataFrame:
    """Rows and percentage of every group, zeros filled, in group order.

    The total is taken over the summary's few rows, not over the data.
    """
    counts = final_distribution(df, group_col)
    total = F.sum("rows").over(W.partitionBy(F.lit(0)))
    return counts.withColumn("pct", F.round(F.try_divide(100.0 * F.col("rows"), total), 2))


def guardrail_violations(shares: DataFrame, ranges: dict = fv.SHARE_GUARDRAILS) -> DataFrame:
    """Groups whose percentage is out of range; no rows when all hold."""
    limits = small_table(shares.sparkSession, ["group", "min_pct", "max_pct"],
                         [(g, float(lo), float(hi)) for g, (lo, hi) in ranges.items()])
    pct = F.coalesce("pct", F.lit(0.0))
    return (limits.join(shares.select("group", "pct"), "group", "left")
            .withColumn("pct", pct)
            .filter(~F.col("pct").between(F.col("min_pct"), F.col("max_pct"))))


def check_guardrails(shares: DataFrame, ranges: dict = fv.SHARE_GUARDRAILS) -> DataFrame:
    """Raise if a group's share leaves its range, else hand the shares on."""
    bad = guardrail_violations(shares, ranges).orderBy("group").collect()  # <= one per group
    if bad:
        raise ValueError("seniority shares out of range: " + "; ".join(
            f"{r['group']} {r['pct']:.2f}% not in {r.min_pct:g}-{r.max_pct:g}%" for r in bad))
    return shares


