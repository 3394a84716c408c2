"""Text normalisation and tokenisers as column expressions (no Python in tasks)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitilt.functions import fixed_values as fv
from lexitilt.functions.matching import strip


def normalize_text(text: Column) -> Column:
    """Lower case, tech tokens kept as words, URLs and punctuation to single spaces."""
    value = F.lower(F.coalesce(text, F.lit("")))
    value = reduce(lambda v, item: F.replace(v, F.lit(item[0]), F.lit(item[1])),
                   fv.TOKEN_REPLACEMENTS.items(), value)
    value = F.regexp_replace(value, fv.URL_PATTERN, " ")
    value = F.replace(value, F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(value, "[^a-z0-9]+", " "))


def _missing_as(text: Column, nan_parity: bool) -> Column:
    return F.coalesce(text, F.lit("nan" if nan_parity else ""))


def _joined_parts(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.when(p != "", p) for p in parts])


def build_model_text(title: Column, description: Column, skills: Column | None = None,
                     *, nan_parity: bool = False) -> Column:
    """Normalised title, description and skills, joined by single spaces.

    ``nan_parity`` writes the word "nan" for a missing part, as a reader that
    turns missing cells into not-a-number does.
    """
    parts = [title, description] + ([] if skills is None else [skills])
    return _joined_parts(*[normalize_text(_missing_as(p, nan_parity)) for p in parts])


def strip_numbers(normalized: Column) -> Column:
    """Words of digits only go, each with the one space before it."""
    return F.ltrim(F.regexp_replace(
        F.concat(F.lit(" "), normalized), " [0-9]+(?= |$)", ""))


def normalized_description(text: Column, *, without_numbers: bool = False) -> Column:
    value = normalize_text(text)
    return strip_numbers(value) if without_numbers else value


def raw_text(*parts: Column) -> Column:
    return strip(_joined_parts(*[F.coalesce(p, F.lit("")) for p in parts]))


def single_spaced_count(text: Column) -> Column:
    """Words in text whose words are parted by exactly one space."""
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(spaces + 1).cast("bigint")


def digest(text: Column) -> Column:
    return F.sha1(text)


def add_text_columns(df: DataFrame, *, nan_parity: bool = False) -> DataFrame:
    """Model text, token count, normalised forms and both fingerprints.

    Title, description and skills are normalised once each. The model text is
    put together from those results: no rule reaches across the joining space.
    """
    have_skills = "skills_desc" in df.columns
    parts = ["title", "description"] + (["skills_desc"] if have_skills else [])
    normal = df.withColumns({
        "title_exact_norm": normalize_text(F.col("title")),
        "description_exact_norm": normalize_text(F.col("description")),
        "_skills": normalize_text(F.col("skills_desc")) if have_skills else F.lit(""),
    })
    if nan_parity:
        words = [normalize_text(_missing_as(F.col(p), True)) for p in parts]
    else:
        words = [F.col("title_exact_norm"), F.col("description_exact_norm"), F.col("_skills")]
    return (
        normal
        .withColumns({
            "text_raw": raw_text(*[F.col(p) for p in parts]),
            "model_text": _joined_parts(*words),
            "description_template_norm": strip_numbers(F.col("description_exact_norm")),
        })
        .withColumns({
            "token_count": single_spaced_count(F.col("model_text")),
            "title_description_fingerprint": digest(F.concat(
                F.col("title_exact_norm"), F.lit("||"), F.col("description_exact_norm"))),
            "description_template_fingerprint": digest(F.col("description_template_norm")),
        })
        .drop("_skills")
    )


# Synthetic-postings text

def spaced(*parts: Column) -> Column:
    """Parts joined by one space each, missing ones as empty text."""
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])


def clean_text(text: Column) -> Column:
    """Letters only: lower case, URLs and everything else to single spaces."""
    value = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), fv.BARE_URL_PATTERN, " ")
    return F.trim(F.regexp_replace(value, "[^a-z]+", " "))


def clean_for_embeddings(text: Column) -> Column:
    """Words that leak the label go first, then URLs and odd characters."""
    value = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))),
                             "(?U)" + fv.LEAKAGE_PATTERN, " ")
    value = F.regexp_replace(value, fv.BARE_URL_PATTERN, " ")
    return F.trim(F.regexp_replace(value, r"[^a-z0-9.+#_-]+", " "))


def select_synthetic(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *[F.col(f"`{old}`").alias(new)
                              for old, new in fv.SYNTHETIC_COLUMNS.items()])


def add_clean_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "clean_text": clean_text(spaced(*[F.col(c) for c in (
            "description", "experience", "qualifications", "responsibilities")])),
        "embedding_text": clean_for_embeddings(
            spaced(F.col("description"), F.col("responsibilities"))),
    })


def complete_row_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in all, rows without a missing cell, and the difference."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return (df.agg(F.count("*").alias("initial_rows"),
                   F.count_if(complete).alias("complete_rows"))
            .withColumn("dropped_rows", F.col("initial_rows") - F.col("complete_rows")))


# Tokenisers: text column to array of tokens

def whitespace_tokens(text: Column) -> Column:
    bare = strip(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, f"[{fv.WS}]+"))


def letter_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))),
                                F.lit(fv.LETTER_TOKEN_PATTERN), F.lit(0))


def tech_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))),
                                F.lit("(?U)" + fv.TECH_TOKEN_PATTERN), F.lit(0))
