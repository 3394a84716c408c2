import random

from pyspark.sql import functions as F

from lexitilt.operators import dedup


def postings(spark, rows):
    return spark.createDataFrame(rows, "job_id LONG, title STRING, description STRING")


def test_second_identical_row_is_a_duplicate(spark):
    df = postings(spark, [(1, "Software Engineer", "Build APIs"), (2, "Software Engineer", "Build APIs")])
    rows = dedup.prepare_text_corpus(df).orderBy("job_id").collect()
    assert [r.keep_for_model for r in rows] == [True, False]
    assert rows[1].is_exact_duplicate and rows[1].is_template_duplicate
    assert rows[0].duplicate_group_id == rows[1].duplicate_group_id != ""


def brute_force(rows):
    seen_exact, seen_template, sizes, out = set(), set(), {}, {}
    for _, _, text in rows:
        sizes[template(text)] = sizes.get(template(text), 0) + 1
    for job, title, text in sorted(rows):
        exact, tpl = (title.lower(), text.lower()), template(text)
        out[job] = (exact in seen_exact, tpl in seen_template, sizes[tpl] > 1)
        seen_exact.add(exact)
        seen_template.add(tpl)
    return out


def template(text):
    return " ".join(w for w in text.lower().split() if not w.isdigit())


def test_flags_with_a_third_of_all_rows_in_one_group(spark):
    random.seed(5)
    rows = [(i, random.choice("ab"), "hot text 7" if i % 3 == 0 else
             f"text {random.choice('pqrstuv')} {random.randrange(4)}") for i in range(3000)]
    flags = dedup.duplicate_flags(
        dedup.tx.add_text_columns(postings(spark, rows).repartition(13)))
    expected = brute_force(rows)
    got = {r.job_id: (r.is_exact_duplicate, r.is_template_duplicate, r.duplicate_group_id != "")
           for r in flags.collect()}
    assert got == expected
    kept = {r.job_id for r in dedup.keep_for_model(
        dedup.tx.add_text_columns(postings(spark, rows))).collect()}
    assert kept == {j for j, (e, t, _) in expected.items() if not (e or t)}
    assert all(t for e, t, _ in expected.values() if e)  # exact implies template


def test_missing_descriptions_are_copies_of_each_other(spark):
    rows = dedup.prepare_text_corpus(postings(spark, [(3, "b", None), (1, "a", ""), (2, "a", None)]))
    assert {r.job_id: r.keep_for_model for r in rows.collect()} == {1: True, 2: False, 3: False}


def test_capped_copies(spark):
    df = spark.range(300).select(
        F.col("id").alias("job_id"), F.lit("mid").alias("seniority"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "")
        .otherwise(F.col("id").cast("string")).alias("embedding_text"))
    kept = dedup.capped_copies(df).collect()
    hot = sorted(r.job_id for r in kept if r.embedding_text == "hot")
    assert hot == [3 * i for i in range(20)]
    assert sum(r.embedding_text not in ("hot", "") for r in kept) == 100
    assert all(r.embedding_text for r in kept)


def test_first_copies_are_cut_before_the_shuffle(spark):
    df = dedup.tx.add_text_columns(postings(spark, [(1, "a", "b")]))
    plan = dedup.keep_for_model(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_summary(spark):
    df = postings(spark, [(1, "a", "x 1"), (2, "a", "x 2"), (3, "a", "x 2"), (4, "b", "y")])
    values = {r.metric: r.value for r in dedup.duplicate_summary(
        dedup.duplicate_flags(dedup.tx.add_text_columns(df))).collect()}
    assert values == {"rows_total": 4, "rows_kept_for_model": 2, "exact_duplicates": 1,
                      "template_duplicates": 2}
