"""Registered queries: each operator over the derived job-posting tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitilt.functions import fixed_values as fv
from lexitilt.functions import text as tx
from lexitilt.operators import (
    audit, company, corpus, dedup, grams, nearest, neighbours, projection, robustness, scope, seniority,
    slices, training, vectors, weat,
)
from lexitilt.sources.derived import Tables
from lexitilt.sources.staging import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Coordinates in the registered vector queries: those of a training run.
DIMENSIONS = vectors.TrainingConfig.vector_size


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: build(Tables(spark, folder))
    return build


def r6(column: str | Column) -> Column:
    return F.round(column, 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


# Shared stages

def scoped(t: Tables) -> DataFrame:
    lookup = scope.build_industry_lookup(t.job_industries(), t.industries())
    return scope.apply_scope_filter(t.postings(), lookup)


def labeled(t: Tables) -> DataFrame:
    return seniority.apply_seniority_labels(scope.core(scoped(t)))


def labeled_text(t: Tables) -> DataFrame:
    return tx.add_text_columns(labeled(t))


def flags(t: Tables) -> DataFrame:
    return dedup.duplicate_flags(labeled_text(t))


def flagged(narrow: DataFrame) -> DataFrame:
    """Narrow rows with their duplicate flags. They are written once, fingerprints included, so
    the text behind them is worked out once."""
    rows = materialize(narrow, "narrow")
    return rows.drop(dedup.EXACT, dedup.TEMPLATE).join(
        dedup.duplicate_flags(rows, staged=True), "job_id")


def clean_docs(t: Tables) -> DataFrame:
    """Deduplicated core corpus: (group, tokens)."""
    kept = dedup.keep_for_model(labeled_text(t).select(
        "job_id", "seniority_final", "model_text", dedup.TEMPLATE))
    return corpus.with_tokens(kept, F.split("model_text", " "), F.col("seniority_final"))


def synthetic(t: Tables) -> DataFrame:
    return tx.add_clean_columns(t.postings())


def synthetic_tech(t: Tables) -> DataFrame:
    return seniority.add_hybrid_seniority(seniority.tech_subset(synthetic(t)))


def synthetic_docs(t: Tables) -> DataFrame:
    """Capped synthetic corpus: (group, tokens)."""
    capped = dedup.capped_copies(
        synthetic_tech(t).select("job_id", "seniority", "embedding_text"))
    return corpus.with_tokens(capped, tx.tech_tokens(F.col("embedding_text")),
                              F.col("seniority"))


def counted(t: Tables) -> DataFrame:
    """Coded-word counts per core posting, with its fingerprints."""
    rows = robustness.coded_counts(labeled_text(t), F.split("model_text", " "))
    return rows.select("job_id", F.col("seniority_final").alias("group"), "seniority_source",
                       dedup.EXACT, dedup.TEMPLATE, *robustness.COUNTS)


# Profiling

@query
def audit_summary(t):
    return audit.audit_summary(t.postings())


@query
def null_rates(t):
    return rounded(audit.null_rates(t.postings()), "null_pct")


@query
def top_null_rates(t):
    return rounded(audit.top_null_rates(t.postings()), "null_pct")


@query
def date_coverage(t):
    return audit.date_coverage(t.postings())


@query
def date_spans(t):
    return rounded(audit.date_spans(t.postings()), "coverage_pct", "span_days")


@query
def length_quantiles(t):
    return rounded(audit.text_length_quantiles(t.postings()), "description_length")


@query
def join_coverage(t):
    coverage = audit.join_coverage(t.postings(), t.companies(), t.job_industries())
    return rounded(audit.match_rates(coverage), "match_rate")


@query
def level_distribution(t):
    return audit.level_distribution(t.postings())


@query
def stratified_sample(t):
    return audit.sample_by_level(t.postings()).drop("description")


@query
def noisy_labels(t):
    return audit.noisy_examples(t.postings()).drop("description")


# Scope

@query
def industry_lookup(t):
    return scope.build_industry_lookup(t.job_industries(), t.industries())


@query
def scope_decisions(t):
    return scoped(t).select("job_id", "title", "is_tech_industry", "industry_name",
                            "scope_include", "scope_reason", "scope_exclusion_reason",
                            "is_broad_tech_company")


@query
def scope_summary(t):
    return scope.scope_summary(scoped(t))


@query
def scope_breakdown(t):
    return scope.scope_reasons(scoped(t))


@query
def top_industries(t):
    return scope.top_industries(scoped(t))


@query
def scope_audit_sample(t):
    return scope.scope_audit_samples(scoped(t))


# Seniority

@query
def seniority_labels(t):
    return labeled(t).select("job_id", "raw_experience_level", "seniority_final",
                             "seniority_source", "seniority_rule")


@query
def override_review(t):
    return seniority.override_review(labeled(t))


@query
def seniority_source_counts(t):
    return seniority.source_counts(labeled(t))


@query
def seniority_source_pivot(t):
    return seniority.source_pivot(labeled(t)).drop("group_order")


@query
def seniority_distribution(t):
    return seniority.final_distribution(labeled(t)).drop("group_order")


@query
def seniority_keep_pivot(t):
    rows = flagged(labeled_text(t).select("job_id", "seniority_final", dedup.EXACT, dedup.TEMPLATE))
    return seniority.keep_pivot(rows).drop("group_order")


@query
def experience_parsed(t):
    years = seniority.parse_experience(F.col("experience"))
    return t.postings().select("job_id", years.alias("y")).select("job_id", "y.*")


@query
def degree_levels(t):
    return t.postings().select(
        "job_id", seniority.degree_level(F.col("qualifications")).alias("degree"))


@query
def title_filters(t):
    return t.postings().select(
        "job_id",
        seniority.is_tech_title(F.col("title")).alias("is_tech"),
        seniority.is_data_research_title(F.col("title")).alias("is_data_research"))


@query
def seniority_hybrid(t):
    return seniority.add_hybrid_seniority(synthetic(t)).select("job_id", "seniority")


@query
def seniority_scored(t):
    return seniority.add_scored_seniority(synthetic(t)).select("job_id", "seniority")


@query
def tech_share(t):
    return rounded(seniority.tech_share(t.postings()), "pct_tech")


@query
def seniority_shares(t):
    return rounded(seniority.distribution(synthetic_tech(t)).drop("group_order"), "pct")


@query
def seniority_guardrails(t):
    shares = seniority.distribution(synthetic_tech(t))
    return rounded(seniority.guardrail_violations(shares), "pct")


# Text

@query
def text_normalised(t):
    return tx.add_text_columns(t.postings()).select(
        "job_id", "title_exact_norm", "description_exact_norm", "description_template_norm")


@query
def model_text(t):
    return tx.add_text_columns(t.postings()).select(
        "job_id", "text_raw", "model_text", "token_count")


@query
def model_text_nan_parity(t):
    return tx.add_text_columns(t.postings(), nan_parity=True).select(
        "job_id", "model_text", "token_count")


@query
def text_fingerprints(t):
    return tx.add_text_columns(t.postings()).select("job_id", dedup.EXACT, dedup.TEMPLATE)


@query
def clean_text_synthetic(t):
    return synthetic(t).select("job_id", "clean_text")


@query
def embedding_text_synthetic(t):
    return synthetic(t).select("job_id", "embedding_text")


@query
def mean_token_lengths(t):
    return synthetic(t).agg(*[
        r6(F.avg(tx.single_spaced_count(F.col(c)))).alias(f"mean_{c}_tokens")
        for c in ("clean_text", "embedding_text")])


@query
def tokeniser_counts(t):
    text = F.col("embedding_text")
    return synthetic(t).select("job_id", *[
        F.size(tokens).cast("bigint").alias(name) for name, tokens in (
            ("whitespace_tokens", tx.whitespace_tokens(text)),
            ("letter_tokens", tx.letter_tokens(text)),
            ("tech_tokens", tx.tech_tokens(text)))])


@query
def complete_rows(t):
    return tx.complete_row_counts(t.postings(), list(fv.SYNTHETIC_COLUMNS.values()))


# Duplicates

@query
def dedup_flags(t):
    return flags(t)


@query
def duplicate_summary(t):
    return dedup.duplicate_summary(flags(t))


@query
def kept_postings(t):
    return dedup.keep_for_model(labeled_text(t).select(
        "job_id", "seniority_final", "token_count", dedup.TEMPLATE)).drop(dedup.TEMPLATE)


@query
def capped_dedup(t):
    return dedup.capped_copies(
        synthetic_tech(t).select("job_id", "seniority", "embedding_text")
    ).select("job_id", "seniority")


# Corpus

@query
def corpus_stats(t):
    return rounded(corpus.with_min_counts(corpus.corpus_stats(synthetic_docs(t))), "avg_doc_len")


@query
def vocabulary(t):
    return corpus.vocabulary(clean_docs(t))


@query
def top_words(t):
    docs = corpus.with_tokens(synthetic_tech(t), tx.whitespace_tokens(F.col("embedding_text")),
                              F.col("seniority"))
    return corpus.top_words(docs).withColumn("rank", F.col("rank").cast("bigint"))


@query
def group_profile(t):
    docs = corpus.with_tokens(synthetic_tech(t), tx.whitespace_tokens(F.col("embedding_text")),
                              F.col("seniority"))
    return corpus.group_profile(docs, "mid").withColumn("rank", F.col("rank").cast("bigint"))


@query
def leakage_check(t):
    capped = dedup.capped_copies(
        synthetic_tech(t).select("job_id", "seniority", "embedding_text"))
    return corpus.leakage_check(corpus.with_tokens(
        capped, tx.whitespace_tokens(F.col("embedding_text")), F.col("seniority")))


@query
def training_metadata(t):
    return corpus.training_metadata(clean_docs(t))


@query
def mean_metadata(t):
    means = corpus.mean_metadata(corpus.training_metadata(clean_docs(t))).drop("group_order")
    return rounded(means, "documents", "sentences", "token_count", "vocab_size", "min_count")


# Vectors

WORDS = weat.spec_words(fv.WEAT_SPECS)
WORDS_SYNTHETIC = weat.spec_words(fv.WEAT_SPECS_SYNTHETIC)


@query
def ppmi_vectors(t):
    return rounded(vectors.ppmi_vectors(clean_docs(t), WORDS).cells, "weight")


@query
def ppmi_neighbours(t):
    found = neighbours.neighbours(company.company(clean_docs(t)))
    return rounded(found, "similarity").withColumn("rank", F.col("rank").cast("bigint"))


@query
def dense_vectors(t):
    table = vectors.dense_vectors(vectors.ppmi_vectors(clean_docs(t), WORDS),
                                  vector_size=DIMENSIONS)
    return table.select("group", "seed", "word", "n",
                        F.posexplode("vector").alias("i", "x")).withColumn("x", r6("x"))


def dense_table(t: Tables) -> DataFrame:
    """Projected vectors of the whole vocabulary, every group and seed."""
    return projection.dense_vectors(company.company(clean_docs(t)), vector_size=DIMENSIONS)


@query
def dense_vocabulary(t):
    """Each word's vector by its length and the sum of its coordinates times their places."""
    squares = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    places = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0),
                         lambda total, x: total + x)
    return dense_table(t).select("group", "seed", "word", "n", r6(F.sqrt(squares)).alias("length"),
                                 r6(places).alias("moment"))


@query
def subword_ngrams(t):
    return vectors.subword_counts(corpus.vocabulary(clean_docs(t)))


@query
def subword_vectors(t):
    """The listed words smoothed by the grams of the whole vocabulary, every seed."""
    return (vectors.compose_subwords(dense_table(t), WORDS, vector_size=DIMENSIONS)
            .select("group", "seed", "word", F.posexplode("vector").alias("i", "x"))
            .withColumn("x", r6("x")))


#: Of the registered queries that fit or train: a floor under the counts, and sizes to go with it.
FLOOR = 5
TRAINED = training.Factorisation(vector_size=50, epochs=3)
#: Gram vectors are fitted in the steps and coordinates that the job takes, to words of each group's own floor.
RIDGE = grams.Ridge()


@query
def gram_ridge(t):
    """How near words made of solved gram vectors come to the words, and those made of means."""
    near = company.company(clean_docs(t))
    links = materialize(slices.gram_links(near.vocabulary, RIDGE), "links")
    found = []
    for seed in fv.SEEDS:  # a seed's vectors are given back before the next
        table = slices.cut(projection.dense_vectors(near, [seed], RIDGE.vector_size), links, RIDGE)
        solved = grams.reconstruction(grams.composed(grams.fit(table, RIDGE), table), table)
        means = grams.reconstruction(
            vectors.compose_subwords(table, vector_size=RIDGE.vector_size), table)
        found.append(solved.join(means.select("group", "seed", F.col("error").alias("mean_error")),
                                 ["group", "seed"]))
    return rounded(functools.reduce(DataFrame.unionByName, found), "error", "mean_error")


@query
def nearest_words(t):
    """The ten nearest of every vector of the embeddings table within its model."""
    table = vector_models(t).select("group", "seed", F.col("vec_id").cast("string").alias("word"),
                                    F.col("embedding").alias("vector"))
    return rounded(nearest.nearest_words(table), "similarity").withColumn(
        "rank", F.col("rank").cast("bigint"))


# Association tests

LABEL_SPEC = {"labels": {"targets_a": ["0", "1", "2"], "targets_b": ["3", "4", "5"],
                         "attributes_a": ["6", "7"], "attributes_b": ["8", "9"]}}


def vector_models(t: Tables) -> DataFrame:
    """The embeddings table as vectors of twelve models: (group, seed, vec_id, label, ...)."""
    group = F.element_at(F.array(*[F.lit(g) for g in fv.GROUP_ORDER]),
                         (F.col("vec_id") % 4 + 1).cast("int"))
    seed = F.element_at(F.array(*[F.lit(s) for s in fv.SEEDS]),
                        (F.floor(F.col("vec_id") / 4) % 3 + 1).cast("int"))
    return t.read("embeddings").select(
        group.alias("group"), seed.alias("seed"), "vec_id",
        F.col("label").cast("string").alias("label"), "embedding")


def centroid_models(t: Tables) -> vectors.WordVectors:
    """Words are labels, each with the mean of its vectors in the model."""
    cells = (vector_models(t)
             .select("group", "seed", F.col("label").alias("word"),
                     F.posexplode("embedding").alias("ctx", "x"))
             .groupBy("group", "seed", "word", "ctx")
             .agg(F.avg(F.col("x").cast("double")).alias("weight"), F.count("*").alias("n")))
    return vectors.WordVectors(
        cells.groupBy("group", "seed", "word").agg(F.max("n").alias("n")),
        cells.drop("n"), ("group", "seed"))


def published_columns(results: DataFrame) -> DataFrame:
    keys = [c for c in ("group", "seed") if c in results.columns]
    return rounded(results.select(*keys, "test_name", *weat.ROLES.values(), "effect_size",
                                  "test_statistic", "p_value"),
                   "effect_size", "test_statistic", "p_value")


def centroid_results(t: Tables) -> DataFrame:
    return weat.run_weat(centroid_models(t), LABEL_SPEC)


@query
def weat_exact(t):
    return published_columns(centroid_results(t))


@query
def weat_sampled(t):
    return published_columns(weat.run_weat(
        centroid_models(t), LABEL_SPEC, permutations=1000, force_sampled=True))


@query
def weat_blocks(t):
    """Twenty thousand draws a model, in blocks over the tasks."""
    return published_columns(weat.run_weat(
        centroid_models(t), LABEL_SPEC, permutations=20_000, force_sampled=True))


@query
def weat_sequential(t):
    """As many draws as it takes to know each p to half a hundredth."""
    return rounded(weat.run_weat(centroid_models(t), LABEL_SPEC, permutations=1_000_000,
                                 force_sampled=True, error=0.005),
                   "effect_size", "test_statistic", "p_value", "p_error")


def text_vectors(t: Tables, docs=clean_docs, words=tuple(WORDS)) -> vectors.WordVectors:
    return vectors.ppmi_vectors(docs(t), list(words)).saved()


@query
def weat_ppmi(t):
    return published_columns(weat.run_weat(text_vectors(t)))


@query
def weat_associations(t):
    return rounded(weat.associations(text_vectors(t)).drop("ord"), "to_a", "to_b")


@query
def weat_coverage(t):
    covered = weat.coverage(vectors.ppmi_vectors(clean_docs(t), WORDS))
    return weat.coverage_matrix(covered).drop("group_order")


def seeded_results(t: Tables) -> DataFrame:
    """One result per group and seed, on dense vectors of the text."""
    table = vectors.dense_vectors(text_vectors(t), vector_size=DIMENSIONS)
    return weat.run_weat(vectors.from_dense(table).saved())


@query
def weat_seeds(t):
    return published_columns(seeded_results(t))


@query
def weat_trained(t):
    """One result per group and seed, on vectors trained on the text's whole vocabulary."""
    trained = training.train(clean_docs(t), config=TRAINED, min_count_col=F.lit(FLOOR)) \
        .vectors.filter(F.col("word").isin(WORDS))
    return published_columns(weat.run_weat(vectors.from_dense(trained).saved()))


@query
def weat_summary(t):
    return rounded(weat.weat_summary(seeded_results(t)), "effect_size_mean", "effect_size_std",
                   "p_value_mean", *weat.ROLES.values())


@query
def weat_monotonicity(t):
    means = [f"{g}_mean" for g in fv.GROUP_ORDER]
    return rounded(weat.monotonicity(centroid_results(t)), *means, "seed_order_rate")


@query
def weat_text_monotonicity(t):
    """Whether effects rise with seniority in the text's own vectors, over all seeds."""
    means = [f"{g}_mean" for g in fv.GROUP_ORDER]
    return rounded(weat.monotonicity(seeded_results(t)), *means, "seed_order_rate")


@query
def weat_trajectories(t):
    return rounded(weat.effects_by_seed(centroid_results(t)), *fv.GROUP_ORDER)


def synthetic_results(t: Tables) -> DataFrame:
    """Longer lists, at least three words per role, sampled permutations."""
    return weat.run_weat(text_vectors(t, synthetic_docs, WORDS_SYNTHETIC),
                         fv.WEAT_SPECS_SYNTHETIC, permutations=100, min_coverage=3,
                         force_sampled=True)


@query
def weat_interpretation(t):
    results = published_columns(synthetic_results(t))
    return results.withColumn("interpretation", weat.interpret(
        F.col("effect_size"), F.col("p_value")))


# Lexicons and variants

@query
def lexicon_bias(t):
    kept = dedup.keep_for_model(counted(t))
    return rounded(robustness.bias_from_counts(kept), "masculine_per_1000",
                   "feminine_per_1000", "bias_score")


@query
def lexicon_bias_synthetic(t):
    return rounded(robustness.lexicon_bias_synthetic(synthetic_tech(t)), "masculine_per_1000",
                   "feminine_per_1000", "bias_score")


@query
def lexicon_variants(t):
    return rounded(robustness.lexicon_variants(flagged(counted(t))), "masculine_per_1000",
                   "feminine_per_1000", "bias_score")


@query
def scope_benchmark(t):
    return robustness.scope_benchmark(scoped(t))


@query
def variant_duplicates(t):
    """Duplicate summary of the labeled-only corpus, flagged within itself."""
    rows = tx.add_text_columns(robustness.labeled_only(labeled(t)))
    return dedup.duplicate_summary(dedup.duplicate_flags(rows))


@query
def weat_variant_compare(t):
    """Effects of the main corpus and of the labeled-only rerun, in one run.

    The variant rides in the group name, so both corpora share every job.
    """
    rows = labeled_text(t).select("job_id", "seniority_final", "seniority_source",
                                  "model_text", dedup.TEMPLATE)
    tagged = rows.select("*", F.explode(F.array_compact(F.array(
        F.lit("main"),
        F.when(F.col("seniority_source") == "linkedin_primary", "labeled_only"))))
        .alias("variant"))
    kept = dedup.keep_first(tagged, ["variant", dedup.TEMPLATE])
    docs = corpus.with_tokens(kept, F.split("model_text", " "),
                              F.concat_ws("|", "variant", "seniority_final"))
    found = weat.run_weat(vectors.ppmi_vectors(docs, WORDS).saved())
    parts = F.split("group", "[|]")
    summary = weat.weat_summary(found.withColumns({"variant": parts[0], "group": parts[1]}),
                                ("variant", "group"))
    return rounded(robustness.compare_effects(summary, ["main", "labeled_only"])
                   .drop("group_order"), "main", "labeled_only")
