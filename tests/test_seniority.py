import pytest
from pyspark.sql import functions as F

from lexitilt.operators import seniority as se

LABELS = [
    ("Junior Software Engineer", "Mid-Senior level", "entry", "title_override"),
    ("Senior Developer", "Associate", "senior", "title_override"),
    ("Software Engineer", "Entry level", "entry", "linkedin_primary"),
    ("Software Engineer", " Director ", "leadership", "linkedin_primary"),
    ("Software Engineer", "director", "mid", "title_backfill"),
    ("Software Engineer", None, "mid", "title_backfill"),
    ("Product Manager", "Executive", "leadership", "title_backfill"),
    ("Assistant Director", None, "leadership", "title_backfill"),
    ("Sr. Analyst", "Mid-Senior level", "senior", "title_backfill"),
    (None, None, "mid", "title_backfill"),
]


def test_title_and_level_labels(spark):
    df = spark.createDataFrame([(i, t, v) for i, (t, v, _, _) in enumerate(LABELS)],
                               "job_id INT, title STRING, formatted_experience_level STRING")
    rows = {r.job_id: r for r in se.apply_seniority_labels(df).collect()}
    for i, (title, level, group, source) in enumerate(LABELS):
        assert (rows[i].seniority_final, rows[i].seniority_source) == (group, source), title
        assert rows[i].raw_experience_level == level
    assert rows[0].seniority_rule == "entry_title_signal"
    assert rows[2].seniority_rule == "linkedin_experience_level"
    assert rows[5].seniority_rule == "default_mid_backfill"


@pytest.mark.parametrize("text,expected", [
    ("5 to 15 Years", (5, 15, 10)), ("2-4 years", (2, 4, 2)), ("8 Year", (8, 8, 0)),
    ("none", (None, None, None)), (None, (None, None, None)), ("0 TO 1 YEARS", (0, 1, 1))])
def test_experience(spark, text, expected):
    df = spark.createDataFrame([(text,)], "e STRING")
    assert tuple(df.select(se.parse_experience(F.col("e")).alias("y")).select("y.*").first()) == expected


@pytest.mark.parametrize("text,expected", [
    ("PhD", "doctorate"), ("M. Tech", "masters"), (" MBA ", "masters"), ("B.Com", None), (None, None)])
def test_degree(spark, text, expected):
    df = spark.createDataFrame([(text,)], "q STRING")
    assert df.select(se.degree_level(F.col("q"))).first()[0] == expected


CASES = [
    # title, text, experience, degree, hybrid, scored
    ("Intern", "", "5 years", None, "entry", "entry"),
    ("Engineer", "", "0 to 1 years", None, "entry", "entry"),
    ("Engineer", "", "1 to 6 years", None, "entry", "mid"),
    ("Director", "", "3 years", None, "leadership", "mid"),
    ("Director", "", "8 years", None, "leadership", "leadership"),
    ("Director", "", None, None, "mid", "mid"),
    ("Chief Technology Officer", "", None, None, "mid", "leadership"),
    ("Assistant Vice President", "", None, None, "mid", "mid"),
    ("Assistant Manager", "senior mentor", "9 years", "PhD", "senior", "mid"),
    ("Engineer", "we manage teams", "4 years", None, "leadership", "mid"),
    ("Engineer", "mentor", None, None, "senior", "mid"),
    ("Engineer", "mentor a senior", None, None, "senior", "senior"),
    ("Principal Engineer", "", None, None, "senior", "senior"),
    ("Engineer", "", "5 to 9 years", None, "senior", "senior"),
    ("Engineer", "for a graduate", None, None, "mid", "entry"),
    ("Engineer", "for a graduate", "3 years", "MBA", "mid", "mid"),
]


def test_hybrid_and_scored(spark):
    df = spark.createDataFrame(
        [(i, *c[:4]) for i, c in enumerate(CASES)],
        "i INT, title STRING, clean_text STRING, experience STRING, qualifications STRING")
    rows = {r.i: r for r in se.add_scored_seniority(
        se.add_hybrid_seniority(df, "hybrid"), "scored").collect()}
    for i, case in enumerate(CASES):
        assert (rows[i].hybrid, rows[i].scored) == case[4:], case


@pytest.mark.parametrize("title,tech,research", [
    ("Data Scientist", True, True), ("Marketing Data Analyst", False, True),
    ("Statistics Teacher", False, False), ("Test Automation Lead", True, False),
    ("Landscape Architect", False, False), (None, False, False)])
def test_title_filters(spark, title, tech, research):
    df = spark.createDataFrame([(title,)], "t STRING")
    assert tuple(df.select(se.is_tech_title(F.col("t")), se.is_data_research_title(F.col("t")))
                 .first()) == (tech, research)


def test_pivot_and_guardrails(spark):
    df = spark.createDataFrame([("entry",)] * 33 + [("mid",)] * 45 + [("senior",)] * 22, "seniority STRING")
    shares = se.distribution(df)
    assert [(r["group"], r["rows"], r.pct) for r in shares.collect()] == [
        ("entry", 33, 33.0), ("mid", 45, 45.0), ("senior", 22, 22.0), ("leadership", 0, 0.0)]
    assert [r["group"] for r in se.guardrail_violations(shares).collect()] == ["leadership"]
    with pytest.raises(ValueError, match="leadership 0.00%"):
        se.check_guardrails(shares)
    labeled = spark.createDataFrame(
        [("mid", "linkedin_primary")] * 370 + [("mid", "title_backfill")] * 1926,
        "seniority_final STRING, seniority_source STRING")
    rows = {r["group"]: tuple(r)[2:] for r in se.source_pivot(labeled).collect()}
    assert rows["mid"] == (370, 1926, 0) and rows["entry"] == (0, 0, 0)
