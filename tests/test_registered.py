"""Registered queries against DuckDB."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
duckdb = pytest.importorskip("duckdb")
import compare  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from lexitilt.plans.oracles import SMALL_ORACLES  # noqa: E402
from lexitilt.plans.queries import QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
#: Trained, searched or stopped by what is seen: tested against brute force elsewhere.
NO_SQL = ["gram_ridge", "nearest_words", "weat_sequential", "weat_trained"]
NAMES = [n for n in QUERIES if n not in NO_SQL]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return compare.duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    sql = {**SMALL_ORACLES, **oracle_sql()}[name]
    verdict, _, _ = compare.compare(spark, con, FOLDER, name, queries()[name], sql)
    assert verdict.startswith("ok ("), verdict


def test_every_query_has_sql():
    assert set(NAMES) <= {*oracle_sql(), *SMALL_ORACLES} and set(QUERIES) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 4
