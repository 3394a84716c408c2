import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexitilt.operators import grams, slices, vectors
from lexitilt.plans import queries

WORDS = ["lead", "leader", "leading", "leaders", "manage", "manager", "managing", "team", "teams",
         "teamwork", "work", "worker", "working", "care", "caring", "caregiver", "a", "of", "", "über"]


def word_table(spark, size=5):
    rng = np.random.default_rng(2)
    rows = [(g, s, w, 3 + len(w), rng.normal(size=size).tolist()) for g in ("mid", "senior")
            for s in (7, 17) for w in WORDS[:len(WORDS) - (g == "senior")]]
    return spark.createDataFrame(
        rows, "group STRING, seed INT, word STRING, n BIGINT, vector ARRAY<DOUBLE>")


def errors(table, config):
    solved = grams.reconstruction(grams.composed(grams.fit(table, config), table), table)
    means = grams.reconstruction(vectors.compose_subwords(table, vector_size=config.vector_size), table)
    return {(r["group"], r.seed): (r.words, r.error, r.mean_error) for r in solved.join(
        means.select("group", "seed", F.col("error").alias("mean_error")), ["group", "seed"]).collect()}


@pytest.mark.parametrize("slice_bytes, buckets", [(1 << 24, 1 << 21), (8 * 2 * len(WORDS), 9)])
def test_slices_give_what_the_whole_vectors_give(spark, monkeypatch, slice_bytes, buckets):
    monkeypatch.setattr(slices, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(slices, "LANES", 2)
    config, table = grams.Ridge(vector_size=5, steps=3, buckets=buckets), word_table(spark)
    links = slices.gram_links(table.select("group", "word", "n").distinct(), config)
    found, expected = errors(slices.cut(table, links, config), config), errors(table, config)
    assert found.keys() == expected.keys() and len(found) == 4
    for key, (words, *rest) in expected.items():
        assert found[key][0] == words and found[key][1:] == pytest.approx(rest, abs=1e-9)


def test_sums_side_by_side_are_sums(monkeypatch):
    monkeypatch.setattr(slices, "_SIDE", 3)
    monkeypatch.setattr(slices, "_DEEP", 4)
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 8, 40)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    rows, values = rng.integers(0, 30, starts[-1]), rng.normal(size=(30, 4))
    expected = [values[rows[a:b]].sum(axis=0) for a, b in zip(starts, starts[1:])]
    assert np.allclose(slices._Sums(rows, starts).of(values), expected, atol=1e-12)


def test_no_words(spark):
    table, config = word_table(spark).limit(0), grams.Ridge(vector_size=5)
    links = slices.gram_links(table.select("group", "word", "n"), config)
    assert errors(slices.cut(table, links, config), config) == {}


def test_gram_ridge_does_the_whole_job(spark, monkeypatch):
    """All steps, all coordinates and seeds, and words by their group's own floor."""
    assert queries.RIDGE == grams.Ridge() and queries.RIDGE.steps == 12
    rng = random.Random(3)
    rows = [("mid", rng.choices([*WORDS, "once"], k=20)) for _ in range(20)] + [("mid", ["rare"])]
    docs = spark.createDataFrame(rows, "group STRING, tokens ARRAY<STRING>")
    monkeypatch.setattr(queries, "clean_docs", lambda t: docs)
    found = queries.gram_ridge(None).collect()
    assert sorted(r.seed for r in found) == [7, 17, 29]
    assert {r.words for r in found} == {len({w for _, tokens in rows for w in tokens})}
    assert all(r.error < r.mean_error for r in found)
