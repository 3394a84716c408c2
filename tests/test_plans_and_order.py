"""Plans with broadcast joins off, and input order over many files."""

import contextlib
import io as text_io
import re

import pytest

from lexitilt.plans.queries import QUERIES
from lexitilt.sources import tables as io

FOLDER = "/root/testdata/sf0.001"
ABOUT_SCOPE = ["scope_summary", "scope_breakdown", "top_industries", "scope_benchmark",
               "scope_decisions", "seniority_labels", "seniority_distribution",
               "seniority_source_counts", "seniority_source_pivot", "override_review"]


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    out = text_io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def exchanged(plan):
    """What each exchange of a formatted plan takes in and how it deals it out."""
    return re.findall(r"\(\d+\) (?:Exchange|BroadcastExchange)\nInput[^:]*: \[(.*?)\]\n"
                      r"Arguments: (\S+\(.*?\)|\S+)", plan)


@pytest.mark.parametrize("name", ABOUT_SCOPE)
def test_no_text_crosses_the_scope_join(no_broadcast, name):
    found = exchanged(plan_of(QUERIES[name](no_broadcast, FOLDER)))
    assert found and not any(re.search(r"\b(description|text)#", columns) for columns, _ in found)


@pytest.mark.parametrize("name", ["vocabulary", "training_metadata", "mean_metadata"])
def test_words_are_not_dealt_by_their_group_alone(no_broadcast, name):
    for columns, dealt in exchanged(plan_of(QUERIES[name](no_broadcast, FOLDER))):
        assert not (re.match(r"hashpartitioning\(group#\d+, \d+\)", dealt)
                    and re.search(r"\bword#", columns))


@pytest.mark.parametrize("split", ["1k", "128m"])
def test_input_order_follows_files_of_unequal_size(spark, tmp_path, split):
    rows = []
    for name, n in (("a", 10), ("b", 500), ("c", 100)):
        part = [(f"{name}{k:04d}", f"title {k}") for k in range(n)]
        rows += [x for x, _ in part]
        (tmp_path / f"{name}.csv").write_text("id,title\n" + "".join(f"{x},{y}\n" for x, y in part))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = io.read_table(spark, str(tmp_path), ["id", "title"], fmt="csv", order_col="place")
        assert [r.id for r in df.orderBy("place").collect()] == rows
        df.drop("place").write.parquet(str(tmp_path / "p"))
        again = io.read_table(spark, str(tmp_path / "p"), order_col="place")
        assert again.select("place").distinct().count() == len(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
