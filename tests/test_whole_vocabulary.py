"""Queries over whole vocabularies: their pairs and vectors are worked out by parts, never as rows."""

import random

import pytest

from lexitilt.functions import fixed_values as fv
from lexitilt.operators import company, neighbours, vectors
from lexitilt.plans import queries

SCHEMA = "group STRING, tokens ARRAY<STRING>"


def corpus(spark):
    rng = random.Random(5)
    words = ["lead", "leader", "leading", "man", "care", "caring", "a", *[f"word{k}" for k in range(30)], *fv.NEIGHBOUR_WORDS]
    rows = [(g, rng.choices(words, range(1, 1 + len(words)), k=rng.randint(0, 25)))
            for g in ("mid", "senior") for _ in range(40)]
    rows += [("senior", ["alone"])] * 6 + [("entry", ["twice", "twice"])] * 3 + [("mid", None)]
    return spark.createDataFrame(rows, SCHEMA)


def refused(*_, **__):
    raise AssertionError("pairs as rows")


def test_dense_table_makes_no_rows_of_pairs(spark, monkeypatch):
    docs = corpus(spark)
    expected = {(r["group"], r.seed, r.word): r for r in vectors.dense_vectors(vectors.ppmi_vectors(docs)).collect()}
    monkeypatch.setattr(vectors, "associated_pairs", refused)
    monkeypatch.setattr(queries, "clean_docs", lambda t: docs)
    found = queries.dense_table(None).collect()
    assert len(found) == len(expected) > 100
    for r in found:
        other = expected[r["group"], r.seed, r.word]
        assert r.n == other.n and r.vector == pytest.approx(other.vector, abs=1e-9)


def test_listed_words_take_one_reading_of_the_vectors(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(g, s, w, 2 + k, [rng.random() for _ in range(4)]) for g in ("mid", "senior") for s in (7, 17)
            for k, w in enumerate(["lead", "leader", "leading", "mislead", "a", "über", "überall", "x"])]
    rows.append(rows[0])  # a repeated row counts again
    table = spark.createDataFrame(rows, "group STRING, seed INT, word STRING, n BIGINT, vector ARRAY<DOUBLE>")
    whole = {(r["group"], r.seed, r.word): r.vector for r in vectors.compose_subwords(table, vector_size=4).collect()}
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    seen = table.mapInArrow(counted, table.schema)
    some = vectors.compose_subwords(seen, ["lead", "über", "a", "none"], vector_size=4).collect()
    assert {(r["group"], r.seed, r.word) for r in some} == {k for k in whole if k[2] in ("lead", "über", "a")}
    for r in some:
        assert r.vector == pytest.approx(whole[r["group"], r.seed, r.word], abs=1e-12)
    assert read.value == len(rows)
    monkeypatch.setattr(vectors, "_SUM_BYTES", 1)  # sums handed on at every change of model
    again = vectors.compose_subwords(table, ["lead"], vector_size=4).collect()
    assert [r.vector for r in again] and all(
        r.vector == pytest.approx(whole[r["group"], r.seed, r.word], abs=1e-12) for r in again)


@pytest.mark.parametrize("cut", [False, True])
def test_neighbours_by_parts_are_those_of_all_cells(spark, monkeypatch, cut):
    docs, asked = corpus(spark), ["lead", "man", "alone", "absent"]
    expected = vectors.neighbours(vectors.ppmi_vectors(docs), asked, 4).collect()
    if cut:
        monkeypatch.setattr(company, "PART_WORDS", 9)
        monkeypatch.setattr(company, "CHUNK_TOKENS", 60)
    near = company.company(docs)
    assert (near.units > 3) == cut
    found = neighbours.neighbours(near, asked, 4).collect()
    key = lambda r: (r["group"], r["query"], r["rank"])
    assert len(found) == len(expected) >= 8
    for a, b in zip(sorted(found, key=key), sorted(expected, key=key)):
        assert key(a) == key(b) and a.word == b.word and a.similarity == pytest.approx(b.similarity, abs=1e-8)


def test_neighbours_query_makes_no_rows_of_pairs(spark, monkeypatch):
    docs = corpus(spark)
    monkeypatch.setattr(vectors, "associated_pairs", refused)
    monkeypatch.setattr(queries, "clean_docs", lambda t: docs)
    assert queries.ppmi_neighbours(None).count() > 0
