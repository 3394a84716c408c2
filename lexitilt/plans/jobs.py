"""The runs a user starts: audit, scope, label, train, weat, robustness, prep_all.

Each reads tables, writes tables under ``root`` and returns their paths. Stages
hand over through those tables, so every run starts from files.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitilt.functions import fixed_values as fv
from lexitilt.functions import text as tx
from lexitilt.operators import (
    audit, corpus, dedup, grams, nearest, robustness, scope, seniority, training, vectors, weat,
)
from lexitilt.sources import tables as io
from lexitilt.sources.staging import materialize

PREFIX = "digital_tech"
BROAD_PREFIX = "broad_tech_company"
#: A posting's place in the input; unique, and sorted as the input is.
ORDER = "input_order"


@dataclass(frozen=True)
class Inputs:
    """Paths of the raw tables (parquet, or CSV by file name)."""

    postings: str
    job_industries: str
    industries: str
    companies: str


def _save(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    return {name: io.write_table(df, f"{folder}/{name}") for name, df in tables.items()}


def run_audit(spark: SparkSession, inputs: Inputs, root: str,
              nrows: int | None = None) -> dict[str, str]:
    """The input is read once, as it is written with its order; the audit reads what was written
    and what was observed meanwhile."""
    raw = io.read_table(spark, inputs.postings, nrows=nrows, order_col=ORDER)
    columns = [c for c in raw.columns if c != ORDER]
    watched, seen = audit.observed(raw, columns)
    path = io.write_table(watched, f"{root}/audit/postings")
    return {"postings": path, **_save(audit.audit_tables(
        spark.read.parquet(path), columns, seen.get, io.load_companies(spark, inputs.companies),
        io.load_job_industries(spark, inputs.job_industries), ORDER), f"{root}/audit")}


def run_scope(spark: SparkSession, inputs: Inputs, root: str,
              nrows: int | None = None) -> dict[str, str]:
    """Scope every posting once; the slices and summaries read that table."""
    postings = io.read_table(spark, inputs.postings, fv.POSTING_COLUMNS, nrows,
                             order_col=ORDER)
    lookup = scope.build_industry_lookup(io.load_job_industries(spark, inputs.job_industries),
                                         io.load_industries(spark, inputs.industries))
    all_path = io.write_table(scope.apply_scope_filter(postings, lookup), f"{root}/scope_all")
    scoped = spark.read.parquet(all_path)
    return {"scope_all": all_path, **_save({
        "core": scope.core(scoped), "broad": scope.broad(scoped)}, root), **_save({
            "scope_summary": scope.scope_summary(scoped),
            "scope_reasons": scope.scope_reasons(scoped),
            "top_industries": scope.top_industries(scoped),
            "audit_samples": scope.scope_audit_samples(scoped)}, f"{root}/scope")}


def run_label(spark: SparkSession, root: str, *, source: str | None = None,
              prefix: str = PREFIX, row_id: str = ORDER,
              nan_parity: bool = False) -> dict[str, str]:
    """Label, normalise and flag duplicates within ``source`` (the core by default).

    The first copy in the order of the input, ``row_id``, is the one that counts. Text
    columns are staged once; the flags read its narrow columns and join back.
    """
    df = spark.read.parquet(source or f"{root}/core")
    prepared = materialize(tx.add_text_columns(
        seniority.apply_seniority_labels(df), nan_parity=nan_parity), "prepared")
    path = io.write_table(dedup.add_duplicate_flags(prepared, row_id, staged=True),
                          f"{root}/{prefix}_labeled")
    labeled = spark.read.parquet(path)
    return {
        "labeled": path,
        "clean": io.export_group_corpora(labeled, f"{root}/{prefix}_clean", kept_only=True),
        "nondedup": io.export_group_corpora(labeled, f"{root}/{prefix}_nondedup",
                                            kept_only=False),
        "labeled_only": io.write_table(robustness.labeled_only(labeled),
                                       f"{root}/{prefix}_labeled_only"),
        **_save({
            "override_review": seniority.override_review(labeled),
            "seniority_summary": seniority.source_counts(labeled),
            "duplicate_summary": dedup.duplicate_summary(labeled)}, f"{root}/labeling/{prefix}"),
    }


def group_corpus(spark: SparkSession, root: str, prefix: str = PREFIX,
                 groups: Sequence[str] = tuple(fv.GROUP_ORDER)) -> DataFrame:
    """(group, tokens) of the clean corpora; only the named groups' folders are read."""
    df = spark.read.parquet(f"{root}/{prefix}_clean")
    return corpus.with_tokens(df.filter(F.col("seniority_final").isin(list(groups))),
                              tx.whitespace_tokens(F.col("model_text")),
                              F.col("seniority_final"))


def run_train(spark: SparkSession, root: str, *, prefix: str = PREFIX,
              seeds: Sequence[int] = tuple(fv.SEEDS),
              config: vectors.TrainingConfig = vectors.TrainingConfig(),
              groups: Sequence[str] = tuple(fv.GROUP_ORDER),
              specs=fv.WEAT_SPECS) -> dict[str, str]:
    """Vectors of the whole vocabulary per group and seed, their metadata, and the listed
    words' vectors smoothed by their subwords."""
    docs = group_corpus(spark, root, prefix, groups)
    table = vectors.dense_vectors(vectors.ppmi_vectors(docs, window=config.window), seeds,
                                  config.vector_size)
    path = io.write_table(table, f"{root}/vectors/{prefix}", partition_by=["group", "seed"])
    return {
        "vectors": path,
        "subwords": io.write_table(vectors.compose_subwords(
            spark.read.parquet(path), weat.spec_words(specs), vector_size=config.vector_size,
            min_n=config.min_n, max_n=config.max_n), f"{root}/subwords/{prefix}"),
        "metadata": io.write_table(corpus.training_metadata(docs, seeds),
                                   f"{root}/training_metadata/{prefix}"),
    }


def run_factorise(spark: SparkSession, root: str, *, prefix: str = PREFIX,
                  seeds: Sequence[int] = tuple(fv.SEEDS),
                  config: training.Factorisation = training.Factorisation(),
                  groups: Sequence[str] = tuple(fv.GROUP_ORDER)) -> dict[str, str]:
    """Trained vectors of the whole vocabulary per group and seed, and the loss of each half step.

    They are saved beside the projected ones, under ``{prefix}_trained``, where the other runs
    find them by that prefix.
    """
    trained = training.train(group_corpus(spark, root, prefix, groups), seeds, config)
    return {
        "vectors": io.write_table(trained.vectors, f"{root}/vectors/{prefix}_trained",
                                  partition_by=["group", "seed"]),
        "losses": io.write_table(trained.losses, f"{root}/losses/{prefix}_trained"),
    }


def run_grams(spark: SparkSession, root: str, *, prefix: str = PREFIX,
              config: grams.Ridge = grams.Ridge()) -> dict[str, str]:
    """Gram vectors of every saved model, solved by ridge, the words they give, and how near
    those come to the saved ones."""
    table = spark.read.parquet(f"{root}/vectors/{prefix}")
    fitted = grams.fit(table, config)
    made = io.write_table(grams.composed(fitted, table), f"{root}/grams/{prefix}/words",
                          partition_by=["group", "seed"])
    return {"words": made, **_save({
        "vectors": fitted.vectors, "residuals": fitted.residuals,
        "errors": grams.reconstruction(spark.read.parquet(made), table)}, f"{root}/grams/{prefix}")}


def run_neighbours(spark: SparkSession, root: str, *, prefix: str = PREFIX, k: int = 10,
                   forest: nearest.Forest = nearest.Forest()) -> dict[str, str]:
    """The nearest words of every word of every saved model."""
    table = spark.read.parquet(f"{root}/vectors/{prefix}")
    return {"neighbours": io.write_table(nearest.nearest_words(table, k, forest),
                                         f"{root}/neighbours/{prefix}", partition_by=["group", "seed"])}


def run_weat(spark: SparkSession, root: str, *, prefix: str = PREFIX,
             seeds: Sequence[int] = tuple(fv.SEEDS), permutations: int = 1000,
             specs=fv.WEAT_SPECS) -> dict[str, str]:
    """Tests on saved vectors; only the named seeds' folders are read."""
    table = (spark.read.parquet(f"{root}/vectors/{prefix}")
             .filter(F.col("seed").isin(list(seeds))
                     & F.col("word").isin(weat.spec_words(specs))))
    path = io.write_table(weat.run_weat(vectors.from_dense(table), specs,
                                        permutations=permutations),
                          f"{root}/weat/{prefix}/seed_results")
    results = spark.read.parquet(path)
    return {"seed_results": path, **_save({
        "summary": weat.weat_summary(results),
        "monotonicity": weat.monotonicity(results),
        "trajectories": weat.effects_by_seed(results)}, f"{root}/weat/{prefix}")}


def run_robustness(spark: SparkSession, root: str, *, prefix: str = PREFIX) -> dict[str, str]:
    labeled = spark.read.parquet(f"{root}/{prefix}_labeled")
    counted = robustness.coded_counts(
        labeled.withColumnRenamed("seniority_final", "group"),
        tx.whitespace_tokens(F.col("model_text")))
    return _save({
        "lexicon_variants": robustness.lexicon_variants(counted),
        "scope_benchmark": robustness.scope_benchmark(spark.read.parquet(f"{root}/scope_all")),
    }, f"{root}/robustness/{prefix}")


def run_prep_all(spark: SparkSession, inputs: Inputs, root: str,
                 nrows: int | None = None) -> dict[str, str]:
    return {**run_scope(spark, inputs, root, nrows), **run_label(spark, root)}


def run_variants(spark: SparkSession, root: str, *, seeds: Sequence[int] = tuple(fv.SEEDS),
                 config: vectors.TrainingConfig = vectors.TrainingConfig(),
                 permutations: int = 1000, specs=fv.WEAT_SPECS) -> dict[str, dict[str, str]]:
    """Labelling rerun on the labeled-only and the broad corpus, flagged within each; the
    labeled-only corpus then goes through training and tests like the main one, whose results
    (of ``run_weat``) are set beside its own."""
    raw = [ORDER, *fv.POSTING_COLUMNS, "is_tech_industry", "industry_name", "scope_include",
           "scope_reason", "scope_exclusion_reason", "is_broad_tech_company"]
    labeled_only = spark.read.parquet(f"{root}/{PREFIX}_labeled_only")
    source = io.write_table(labeled_only.select([c for c in raw if c in labeled_only.columns]),
                            f"{root}/labeled_only_source")
    prefix = f"{PREFIX}_labeled_only_run"
    paths = {
        "labeled_only": run_label(spark, root, source=source, prefix=prefix),
        "broad": run_label(spark, root, source=f"{root}/broad", prefix=BROAD_PREFIX),
        "training": run_train(spark, root, prefix=prefix, seeds=seeds, config=config, specs=specs),
        "weat": run_weat(spark, root, prefix=prefix, seeds=seeds, permutations=permutations,
                         specs=specs),
    }
    both = {"main": PREFIX, "labeled_only": prefix}
    summaries = io.write_table(robustness.tagged_union(
        {name: spark.read.parquet(f"{root}/weat/{p}/summary") for name, p in both.items()}),
        f"{root}/variants/weat_summaries")
    paths["comparison"] = {"weat_summaries": summaries, **_save({
        "effects": robustness.compare_effects(spark.read.parquet(summaries), list(both)),
        "training_metadata": robustness.tagged_union(
            {name: spark.read.parquet(f"{root}/training_metadata/{p}") for name, p in both.items()}),
        "duplicates": robustness.tagged_union(
            {name: spark.read.parquet(f"{root}/labeling/{p}/duplicate_summary")
             for name, p in both.items()})}, f"{root}/variants")}
    return paths


def run_synthetic(spark: SparkSession, path: str, root: str, *, guard: bool = True,
                  copies: int = 20, permutations: int = 100, seed: int = 42,
                  config: vectors.TrainingConfig = vectors.SYNTHETIC_TRAINING,
                  ) -> dict[str, str]:
    """The run over synthetic postings: clean, keep tech titles, label by title, text and
    experience, check the shares, cap identical texts, train, test, count coded words. Vectors are
    those of the whole vocabulary, smoothed by grams of ``min_n`` to ``max_n`` characters.

    The input has no id, so rows are numbered in input order when the cleaned table is
    written; later stages read that table. With ``guard`` shares out of range stop the run.
    """
    raw = io.read_table(spark, path, list(fv.SYNTHETIC_COLUMNS), order_col="row_id")
    numbered = tx.select_synthetic(raw, keep=["row_id"])
    paths = {"clean": io.write_table(tx.add_clean_columns(numbered), f"{root}/clean")}
    cleaned = spark.read.parquet(paths["clean"])
    paths["tech"] = io.write_table(
        seniority.add_hybrid_seniority(seniority.tech_subset(cleaned)), f"{root}/tech")
    tech = spark.read.parquet(paths["tech"])
    shares = seniority.distribution(tech)
    if guard:
        seniority.check_guardrails(shares)
    paths["groups"] = io.write_table(
        dedup.capped_copies(tech, row_id="row_id", copies=copies), f"{root}/groups",
        partition_by=["seniority"])
    docs = corpus.with_tokens(io.load_corpus(spark, paths["groups"]),
                              tx.tech_tokens(F.col("embedding_text")), F.col("seniority"))
    sparse = vectors.ppmi_vectors(
        docs, window=config.window,
        min_count_col=corpus.min_count_synthetic(F.col("docs"), F.col("vocab_size")))
    paths["vectors"] = io.write_table(
        vectors.dense_vectors(sparse, [seed], config.vector_size), f"{root}/vectors",
        partition_by=["group", "seed"])
    paths["subwords"] = io.write_table(
        vectors.compose_subwords(spark.read.parquet(paths["vectors"]),
                                 vector_size=config.vector_size, min_n=config.min_n,
                                 max_n=config.max_n), f"{root}/subwords",
        partition_by=["group", "seed"])
    smooth = spark.read.parquet(paths["subwords"]).filter(
        F.col("word").isin(weat.spec_words(fv.WEAT_SPECS_SYNTHETIC)))
    found = weat.run_weat(
        vectors.from_dense(smooth).saved(), fv.WEAT_SPECS_SYNTHETIC,
        permutations=permutations, min_coverage=3, force_sampled=True)
    return {**paths, **_save({
        "complete_rows": tx.complete_row_counts(cleaned, list(fv.SYNTHETIC_COLUMNS.values())),
        "shares": shares,
        "corpus_stats": corpus.with_min_counts(corpus.corpus_stats(docs)),
        "leakage": corpus.leakage_check(docs),
        "top_words": corpus.top_words(docs),
        "weat": found.withColumn("interpretation", weat.interpret(
            F.col("effect_size"), F.col("p_value"))),
        "lexicon_bias": robustness.lexicon_bias_synthetic(tech)}, f"{root}/results")}
