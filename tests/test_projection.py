import random

import pytest
from pyspark.sql import functions as F

from lexitilt.operators import company, projection, vectors

SCHEMA = "group STRING, tokens ARRAY<STRING>"


def corpus(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    rows = [(g, rng.choices(words, range(1, 41), k=rng.randint(0, 30)))
            for g in ("mid", "senior") for _ in range(40)]
    rows += [("senior", ["alone"])] * 6 + [("entry", ["twice", "twice"])] * 3
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("size", [5, 70])
def test_vectors_are_those_of_the_whole_pair_table(spark, monkeypatch, size):
    monkeypatch.setattr(company, "PART_WORDS", 11)  # several parts a group
    docs, floor = corpus(spark), F.lit(5)
    sparse = vectors.ppmi_vectors(docs, min_count_col=floor)
    expected = {(r["group"], r.seed, r.word): r
                for r in vectors.dense_vectors(sparse, (7, 17), size).collect()}
    near = company.company(docs, min_count_col=floor)
    assert near.units > 4
    found = projection.dense_vectors(near, (7, 17), size).collect()
    assert len(found) == len(expected) and {r.seed for r in found} == {7, 17}
    for r in found:
        other = expected[r["group"], r.seed, r.word]
        assert r.n == other.n and r.vector == pytest.approx(other.vector, abs=1e-9)
    assert all(not any(r.vector) for r in found if r.word == "alone")


def test_no_words(spark):
    near = company.company(spark.createDataFrame([], SCHEMA), min_count_col=F.lit(5))
    assert projection.dense_vectors(near, (7,), 5).collect() == []
