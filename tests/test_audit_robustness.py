import pytest
from pyspark.sql import functions as F

from lexitilt.operators import audit, robustness

# Published counts (masculine, feminine, tokens), their rates and difference.
RATES = [
    (5661, 4330, 1317684, 4.296174196544847, 3.286068587005686, 1.0101056095391607),
    (1821, 1684, 623900, 2.9187369770796603, 2.699150504888604, 0.2195864721910561),
    (2137, 2790, 769121, 2.7784964914493298, 3.6275176467681938, -0.849021155318864),
    (6441, 6615, 2066579, 3.1167451135427195, 3.200942233517325, -0.08419711997460544),
    (64, 81, 16374, 3.908635641871259, 4.946866984243312, -1.0382313423720526),
    (2112, 1886, 697133, 3.0295510325863213, 2.7053661209553987, 0.32418491163092256),
]


def test_rates_of_published_counts(spark):
    df = spark.createDataFrame([(str(i), *r[:3]) for i, r in enumerate(RATES)] + [("none", 0, 0, 0)],
                               "group STRING, masculine_count LONG, feminine_count LONG, token_total LONG")
    rows = {r["group"]: r for r in robustness.bias_from_counts(df).collect()}
    for i, r in enumerate(RATES):
        got = rows[str(i)]
        assert (got.masculine_per_1000, got.feminine_per_1000, got.bias_score) == pytest.approx(r[3:])
    assert rows["none"].bias_score is None


def test_lexicon_bias_counts_repeats_and_missing_text(spark):
    df = spark.createDataFrame(
        [("mid", "leader leader kind x"), ("mid", None), (None, "leader"), ("entry", "")],
        "seniority_final STRING, model_text STRING")
    rows = {r["group"]: r for r in robustness.lexicon_bias(df).collect()}
    assert set(rows) == {"mid", "entry"}
    assert (rows["mid"].masculine_count, rows["mid"].feminine_count, rows["mid"].token_total) == (2, 1, 4)
    assert rows["entry"].token_total == 0 and rows["entry"].bias_score is None


def test_variants_equal_separate_runs(spark):
    df = spark.range(400).select(
        F.when(F.col("id") % 3 == 0, "mid").otherwise("senior").alias("seniority_final"),
        F.when(F.col("id") % 5 == 0, "linkedin_primary").otherwise("title_backfill").alias("seniority_source"),
        (F.col("id") % 7 != 0).alias("keep_for_model"),
        F.concat_ws(" ", F.lit("driven"), F.when(F.col("id") % 2 == 0, "kind"), F.lit("x")).alias("model_text"))
    counted = robustness.coded_counts(df.withColumnRenamed("seniority_final", "group"), F.split("model_text", " "))
    got = {tuple(r) for r in robustness.lexicon_variants(counted).collect()}
    parts = {"nondedup": df, "labeled_plus_backfilled": df.filter("keep_for_model"),
             "labeled_only": robustness.labeled_only(df).filter("keep_for_model")}
    union = robustness.tagged_union({k: robustness.lexicon_bias(v) for k, v in parts.items()})
    assert got == {tuple(r) for r in union.select("variant", *[c for c in union.columns if c != "variant"]).collect()}


def test_audit_counts(spark):
    df = spark.createDataFrame(
        [(1, "a", "Intern", "Director", 1711317014000), (1, "  \n", "VP", None, None),
         (2, None, "Sr. lead", "Associate", 10**18), (None, "abc", None, None, 0)],
        "job_id LONG, description STRING, title STRING, formatted_experience_level STRING, listed_time LONG")
    values = {r.metric: r.value for r in audit.audit_summary(df).collect()}
    assert values == {"rows": 4, "columns": 5, "duplicate_job_id_count": 1, "description_empty_count": 2}
    dates = audit.date_coverage(df).collect()
    assert [(r.column, r.non_null) for r in dates] == [("listed_time", 2)]
    assert str(dates[0]["max"]) == "2024-03-24 21:50:14"
    rates = audit.null_rates(df).collect()
    assert rates[0].column == "formatted_experience_level" and rates[0].null_pct == 50.0
    noisy = {(r.noise_bucket, r.job_id) for r in audit.noisy_examples(df).collect()}
    assert noisy == {("entry_title_not_entry", 1), ("leadership_title_not_leadership", 1),
                     ("senior_title_not_seniorish", 2)}
    levels = [(r.level, r["count"]) for r in audit.level_distribution(df).collect()]
    assert levels == [("MISSING", 2), ("Associate", 1), ("Director", 1)]


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([("x" * n,) for n in (0, 1, 2, 10)] + [(None,)], "description STRING")
    got = {r.quantile: r.description_length for r in audit.text_length_quantiles(df).collect()}
    assert got[0.0] == 0 and got[0.5] == 1 and got[0.75] == 2
    assert got[0.9] == pytest.approx(6.8) and got[0.99] == pytest.approx(9.68)


def test_coverage_counts_rows_of_a_hot_key(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).cast("long").alias("company_id"))
    df = df.unionByName(spark.createDataFrame([(None,)], "company_id LONG"))
    other = spark.createDataFrame([(1,), (1,), (2,), (None,)], "company_id LONG")
    row = audit.match_rates(audit.key_coverage(df, "company_id", other, "companies")).first()
    assert (row.matched_rows, row.total_rows) == (302, 901)
    assert row.match_rate == pytest.approx(302 / 901 * 100)


def test_samples_per_level(spark):
    df = spark.range(100).select(F.col("id").alias("job_id"),
                                 F.when(F.col("id") % 2 == 0, "Director").alias("formatted_experience_level"))
    rows = audit.sample_by_level(df, 5).collect()
    assert sorted({r.experience_bucket for r in rows}) == ["Director", "MISSING"] and len(rows) == 10
    assert {r.job_id for r in rows} == {r.job_id for r in audit.sample_by_level(df.repartition(9), 5).collect()}
    assert {r.job_id for r in rows} != {r.job_id for r in audit.sample_by_level(df, 5, seed=1).collect()}


def test_compare_effects_keeps_every_group(spark):
    df = spark.createDataFrame([("main", "mid", 0.5), ("labeled_only", "mid", None), ("main", "entry", 0.1)],
                               "variant STRING, group STRING, effect_size_mean DOUBLE")
    rows = robustness.compare_effects(df, ["main", "labeled_only"]).collect()
    assert [(r["group"], r.main, r.labeled_only) for r in rows] == [
        ("entry", 0.1, None), ("mid", 0.5, None), ("senior", None, None), ("leadership", None, None)]
