"""The registered queries of the subpackage and the pipeline."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from lexitilt.llm import decontamination, near_dedup, quality_classifier  # noqa: E402
from lexitilt.llm.oracles import ORACLES  # noqa: E402
from tools.compare import canonical, duck  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_one_query_an_operator():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_duckdb(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    result = duck(FOLDER).execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) \
        == canonical(columns, result.fetchall())


def test_pipeline_stage_by_stage(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality", "near_duplicates", "decontamination", "pii", "mixing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    columns, seen = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], FOLDER).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
        assert k == 4 or seen[-1].columns == columns
    rows = [{r.doc_id: r for r in df.collect()} for df in seen[:5]]
    scored = quality_classifier.score(docs, quality_classifier.train(docs, labels)).collect()
    assert set(rows[1]) == {r.doc_id for r in scored if r.predicted}
    groups = near_dedup.near_duplicates(seen[1]).collect()
    assert set(rows[2]) == {r.component_id for r in groups}
    items = [dict(r.asDict()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    plain = lambda t: f" {' '.join(decontamination.words_of(t))} "
    assert not any(plain(i["text"]) in plain(r.text) for r in rows[3].values() for i in items)
    gone = set(rows[2]) - set(rows[3])
    assert len(gone) <= len(rows[2]) // 10
    assert set(rows[4]) == set(rows[3])
    assert all(r.n_chars == len(r.text) for r in rows[4].values())
    assert any(rows[4][k].text != rows[3][k].text for k in rows[4])
    mix = seen[5].collect()
    words = {k: r.text.split() for k, r in rows[4].items()}
    total = sum(map(len, words.values()))
    assert abs(sum(r.n_words for r in mix) - 1.5 * total) < 0.05 * total
    for r in mix[:200]:
        assert set(r.text.split()) <= {w for d in r.doc_ids for w in words[d]}
        assert all(rows[4][d].source == r.source for d in r.doc_ids)


def test_pipeline_runs_as_a_query(spark):
    assert duckdb and entry.queries()["pipeline"](spark, FOLDER).count() > 0
