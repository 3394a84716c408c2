import pytest
from pyspark.sql import functions as F

from lexitilt.operators import scope

TITLES = [
    # title, description, tech industry, rule
    ("Software Engineer", "Build APIs", False, "title_core"),
    ("Data Entry Clerk", "Update spreadsheets", False, "off_target_business_role"),
    ("Project Manager", "Coordinate vendors", False, "ambiguous_title_without_tech_context"),
    ("Project Manager", "Manage cloud migrations on AWS", False, "ambiguous_title_supported"),
    ("Technical Lead", None, True, "ambiguous_title_supported"),
    ("Head of Product", "", False, "title_leadership"),
    ("iOS Developer", "", False, "title_core"),
    ("Senior Full Stack Developer (Blockchain)", "", False, "title_core"),
    ("M365 Power-Platform SharePoint Online Developer", "", False, "title_core"),
    ("Senior Network Engineer", "", False, "title_core"),
    ("Deputy Chief of Police, Office of Civil Rights", "", False, "non_digital_engineering"),
    ("Lead Systems Operations Process Engineer", "", False, "non_digital_engineering"),
    ("Customer Service Advocate I", "", False, "off_target_business_role"),
    ("Executive Assistant to President/Office Manager", "", False, "off_target_business_role"),
    ("Applications Analyst I", "", False, "no_tech_scope_signal"),
    ("ASSISTANT STORE MANAGER", "software", True, "no_tech_scope_signal"),
    (None, "software", True, "missing_title"),
    ("  \t", "software", True, "missing_title"),
    ("Project Manager", "own the data pipeline", False, "ambiguous_title_without_tech_context"),
    ("Project Manager", "own the datapipeline", False, "ambiguous_title_supported"),
    ("Project Manager", "c++ dev", False, "ambiguous_title_without_tech_context"),
    ("Project Manager", "c++11", False, "ambiguous_title_supported"),
]


def test_scope_cascade(spark):
    df = spark.createDataFrame([(i, t, d, f) for i, (t, d, f, _) in enumerate(TITLES)],
                               "id INT, title STRING, description STRING, is_tech_industry BOOLEAN")
    rows = {r.id: r for r in scope.classify_scope(df).collect()}
    for i, (title, _, _, rule) in enumerate(TITLES):
        row = rows[i]
        assert row.scope_include == (rule in scope.IN_SCOPE), title
        if row.scope_include:
            assert (row.scope_reason, row.scope_exclusion_reason) == (rule, "")
        else:
            reason = rule if rule == "missing_title" else "excluded"
            assert (row.scope_reason, row.scope_exclusion_reason) == (reason, rule), title


@pytest.mark.parametrize("name,expected", [
    ("IT Services and IT Consulting", True), ("Technology, Information and Internet", True),
    ("Retail", False), (None, False), ("Data Infrastructure and Analytics", True)])
def test_tech_industry(spark, name, expected):
    df = spark.createDataFrame([(name,)], "n STRING")
    assert df.select(scope.is_tech_industry(F.col("n"))).first()[0] is expected


def test_industry_lookup_takes_three_names_in_order(spark):
    links = spark.createDataFrame([(1, i) for i in (4, 3, 2, 1, 1, 1)] + [(2, 9)],
                                  "job_id LONG, industry_id LONG")
    industries = spark.createDataFrame(
        [(1, "Zinc"), (2, "Software"), (3, "Banking"), (4, "Mining")],
        "industry_id LONG, industry_name STRING")
    rows = {r.job_id: r for r in scope.build_industry_lookup(links, industries).collect()}
    assert rows[1].industry_name == "Banking | Mining | Software" and rows[1].is_tech_industry
    assert rows[2].industry_name == "" and not rows[2].is_tech_industry


def test_summary_adds_up_and_samples_are_bounded(spark):
    df = spark.range(200).select(
        F.col("id").alias("job_id"),
        F.when(F.col("id") % 3 == 0, "Data Engineer").otherwise("Nurse").alias("title"),
        F.lit("x").alias("description"))
    lookup = spark.createDataFrame([], "job_id LONG, is_tech_industry BOOLEAN, industry_name STRING")
    scoped = scope.apply_scope_filter(df, lookup)
    values = {r.metric: r.value for r in scope.scope_summary(scoped).collect()}
    assert values["rows_in_scope"] + values["rows_out_of_scope"] == values["rows_total"] == 200
    sample = scope.scope_audit_samples(scoped, 25).collect()
    assert len(sample) == 50 and sum(r.scope_include for r in sample) == 25
    again = scope.scope_audit_samples(scoped.repartition(7), 25).collect()
    assert {r.job_id for r in sample} == {r.job_id for r in again}
