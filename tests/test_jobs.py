import csv

import pytest

from lexitilt.operators import audit, grams, training, vectors
from lexitilt.plans import jobs
from lexitilt.sources import split_csv
from lexitilt.sources import tables as io
from lexitilt.streaming.labels import write_labels

HEADER = ["job_id", "company_id", "company_name", "title", "description", "skills_desc",
          "formatted_experience_level", "formatted_work_type", "location", "remote_allowed", "pay_period",
          "min_salary", "med_salary", "max_salary", "posting_domain", "listed_time", "original_listed_time"]
TITLES = ["Software Engineer", "Senior Data Engineer", "Junior Developer", "Engineering Manager", "Nurse"]
LEVELS = ["Entry level", "", "Mid-Senior level", "Director", "Associate"]
TEXT = ('He, his father and "brother" lead business,\nshe, her mother and sister support home and family; '
        "career, office and executive leadership. ")


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")

    def write(name, header, rows):
        with open(folder / name, "w", newline="") as f:
            csv.writer(f).writerows([header, *rows])
        return str(folder / name)

    rows = [[i, f"{i % 7}.0", "c", TITLES[i % 5], TEXT + f"Team {i // 2}, kind and driven " * (1 + i % 3), "",
             LEVELS[i // 3 % 5], "FT", "x", "1.0", "", "", "", "", "", "1.711317014E12", 1711317014000]
            for i in range(100)]
    return jobs.Inputs(
        write("postings.csv", HEADER, rows),
        write("job_industries.csv", ["job_id", "industry_id"], [[i, i % 3] for i in range(90)]),
        write("industries.csv", ["industry_id", "industry_name"], [[0, "Software Development"], [1, "Retail"]]),
        write("companies.csv", ["company_id", "name"], [[i, f"n{i}"] for i in range(6)]))


def test_csv_reader(spark, inputs):
    df = io.load_postings(spark, inputs.postings, ["job_id", "company_id", "description", "listed_time"])
    row = df.orderBy("job_id").first()
    assert df.count() == 100 and row.company_id == 0 and row.listed_time == 1711317014000
    assert '"brother"' in row.description and "\n" in row.description
    assert io.load_postings(spark, inputs.postings, nrows=7).count() == 7
    with pytest.raises(ValueError, match="missing columns"):
        io.load_postings(spark, inputs.postings, ["absent"])


def test_all_jobs_end_to_end(spark, inputs, tmp_path):
    root = str(tmp_path)
    audit = jobs.run_audit(spark, inputs, root)
    assert spark.read.parquet(audit["join_coverage"]).count() == 2
    paths = jobs.run_prep_all(spark, inputs, root)
    labeled = spark.read.parquet(paths["labeled"])
    assert labeled.count() == 80
    clean = spark.read.parquet(paths["clean"])
    assert clean.count() == labeled.filter("keep_for_model").count() < 80
    assert spark.read.parquet(paths["nondedup"]).count() == 80
    trained = jobs.run_train(spark, root, seeds=[7, 17])
    metadata = spark.read.parquet(trained["metadata"])
    assert metadata.filter("seed = 7").agg({"documents": "sum"}).first()[0] == clean.count()
    results = jobs.run_weat(spark, root, seeds=[7, 17])
    seeds = spark.read.parquet(results["seed_results"])
    assert seeds.count() == 2 * clean.select("seniority_final").distinct().count()
    assert seeds.filter("p_value IS NOT NULL").count() > 0
    assert spark.read.parquet(results["monotonicity"]).count() == 1
    robust = jobs.run_robustness(spark, root)
    assert spark.read.parquet(robust["lexicon_variants"]).select("variant").distinct().count() == 3
    variants = jobs.run_variants(spark, root, seeds=[7, 17],
                                 config=vectors.TrainingConfig(vector_size=12))
    only = spark.read.parquet(variants["labeled_only"]["labeled"])
    assert only.count() == labeled.filter("seniority_source = 'linkedin_primary'").count()
    # the main outputs are still what they were
    assert spark.read.parquet(paths["labeled"]).count() == 80
    # the variant went through training and tests
    compared = spark.read.parquet(variants["comparison"]["effects"]).collect()
    assert len(compared) == 4 and any(r.main is not None for r in compared)
    assert any(r.labeled_only is not None for r in compared)
    tagged = spark.read.parquet(variants["comparison"]["training_metadata"])
    assert {r.variant for r in tagged.select("variant").distinct().collect()} == {"main", "labeled_only"}
    # runs over the saved vectors
    factors = jobs.run_factorise(spark, root, seeds=[7, 17],
                                 config=training.Factorisation(vector_size=6, epochs=2))
    assert spark.read.parquet(factors["vectors"]).select("seed").distinct().count() == 2
    again = jobs.run_weat(spark, root, prefix=f"{jobs.PREFIX}_trained", seeds=[7, 17])
    assert spark.read.parquet(again["seed_results"]).filter("p_value IS NOT NULL").count() > 0
    near = spark.read.parquet(jobs.run_neighbours(
        spark, root, prefix=f"{jobs.PREFIX}_trained", k=3)["neighbours"])
    assert near.filter("rank = 1").count() > 0 and near.agg({"rank": "max"}).first()[0] == 3
    made = jobs.run_grams(spark, root, prefix=f"{jobs.PREFIX}_trained",
                          config=grams.Ridge(vector_size=6, steps=4))
    assert spark.read.parquet(made["words"]).count() == spark.read.parquet(factors["vectors"]).count()


def test_one_reading_gives_the_whole_audit(spark, inputs, tmp_path):
    paths = jobs.run_audit(spark, inputs, str(tmp_path))
    postings = io.load_postings(spark, inputs.postings)
    companies = io.load_companies(spark, inputs.companies)
    industries = io.load_job_industries(spark, inputs.job_industries)
    by_input = io.read_table(spark, inputs.postings, order_col="at")
    expected = {
        "audit_summary": audit.audit_summary(postings), "null_rates": audit.null_rates(postings),
        "date_coverage": audit.date_coverage(postings),
        "text_length_summary": audit.text_length_quantiles(postings),
        "join_coverage": audit.join_coverage(postings, companies, industries),
        "experience_examples": audit.sample_by_level(postings),
        "noisy_label_examples": audit.noisy_examples(by_input, row_id="at"),
        "experience_level_distribution": audit.level_distribution(postings)}
    assert set(paths) == {"postings", *expected}
    for name, df in expected.items():
        got = spark.read.parquet(paths[name])
        assert got.columns == df.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, df.collect())), name


def test_audit_reads_the_text_files_once(spark, inputs, tmp_path, monkeypatch):
    reads = []
    read = split_csv.records
    monkeypatch.setattr(split_csv, "records", lambda s, p: reads.append(p) or read(s, p))
    jobs.run_audit(spark, inputs, str(tmp_path))
    assert reads.count(inputs.postings) == 1


def test_noisy_examples_are_the_first_of_the_input(spark, tmp_path):
    rows = [[k, "Senior Engineer", "text", "Entry level"] for k in range(300, 0, -1)]
    with open(tmp_path / "p.csv", "w", newline="") as f:
        csv.writer(f).writerows([["job_id", "title", "description", "formatted_experience_level"], *rows])
    df = io.read_table(spark, f"{tmp_path}/p.csv", order_col="at")
    found = audit.noisy_examples(df, row_id="at")
    assert {r.job_id for r in found.filter("noise_bucket like '%senior%'").collect()} <= set(range(291, 301))
    assert found.count() >= 10


def test_stored_vectors_are_joined_as_they_lie(spark, tmp_path):
    rows = [(g, w, [1.0, 2.0]) for g in ("mid", "senior") for w in ("he", "she", "lead", "care")]
    table = spark.createDataFrame(rows, "group STRING, word STRING, vector ARRAY<DOUBLE>")
    io.save_vectors(table, "stored_vectors", f"{tmp_path}/store", 4)
    wanted = spark.createDataFrame([("he", 1), ("lead", 2), ("absent", 3)], "word STRING, n INT")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = io.lookup_vectors(spark, "stored_vectors", wanted)
        assert sorted((r.word, r.n, r["group"]) for r in found.collect()) == [
            ("he", 1, "mid"), ("he", 1, "senior"), ("lead", 2, "mid"), ("lead", 2, "senior")]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        side = plan.split("== Initial Plan ==")[-1].split("SortMergeJoin")[1]
        assert side.count("Exchange") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE IF EXISTS stored_vectors")


def test_stream_equals_batch(spark, inputs, tmp_path):
    from lexitilt.operators import scope
    postings = io.load_postings(spark, inputs.postings)
    source = io.write_table(postings, f"{tmp_path}/in")
    lookup = scope.build_industry_lookup(io.load_job_industries(spark, inputs.job_industries),
                                         io.load_industries(spark, inputs.industries))
    stream = spark.readStream.schema(postings.schema).parquet(source)
    query = write_labels(stream, lookup, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    query.awaitTermination(120)
    columns = ["job_id", "seniority_final", "scope_reason", "model_text"]
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select(*columns).collect()}
    from lexitilt.streaming.labels import label_stream
    assert got == {tuple(r) for r in label_stream(postings, lookup).select(*columns).collect()}
    assert len(got) == 80


def test_corpus_needs_its_text_column(spark, tmp_path):
    path = io.write_table(spark.createDataFrame([(None,), ("a",)], "embedding_text STRING"), f"{tmp_path}/c")
    assert sorted(r[0] for r in io.load_corpus(spark, path).collect()) == ["", "a"]
    with pytest.raises(ValueError, match="missing columns"):
        io.load_corpus(spark, path, "text")


def test_synthetic_run(spark, tmp_path):
    header = ["Job Id", "Job Title", "Job Description", "Experience", "Qualifications",
              "Responsibilities", "Preference"]
    text = ("he and his father, brother and son lead work, career and office business; "
            "she and her mother, sister and daughter support home, family and children ")
    rows = [[i, "Data Engineer" if i % 4 else "Nurse", text, f"{i % 5} to {i % 5 + 3} Years", "MBA",
             "mentor" if i % 2 else "", "Male"] for i in range(200)]
    with open(tmp_path / "in.csv", "w", newline="") as f:
        csv.writer(f).writerows([header, *rows])
    with pytest.raises(ValueError, match="out of range"):
        jobs.run_synthetic(spark, f"{tmp_path}/in.csv", f"{tmp_path}/guarded")
    paths = jobs.run_synthetic(spark, f"{tmp_path}/in.csv", f"{tmp_path}/out", guard=False)
    assert spark.read.parquet(paths["clean"]).count() == 200
    assert spark.read.parquet(paths["tech"]).count() == 150
    per_text = spark.read.parquet(paths["groups"]).groupBy("seniority", "embedding_text").count()
    assert {r["count"] for r in per_text.collect()} == {20}
    found = spark.read.parquet(paths["weat"]).collect()
    assert {r["group"] for r in found} == {r.seniority for r in per_text.collect()}
    assert all(0 < r.p_value <= 1 and "association" in r.interpretation for r in found)
