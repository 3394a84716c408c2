import numpy as np
import pytest
from pyspark.sql import functions as F

from lexitilt.operators import nearest


def vector_table(spark, n, size=12, groups=("mid", "senior"), seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 20 + 1, size))
    rows = [(g, 7, f"w{k}", (centres[k % len(centres)] + rng.normal(size=size) * 0.6 + 0.5).tolist())
            for g in groups for k in range(n)]
    return spark.createDataFrame(rows, "group STRING, seed INT, word STRING, vector ARRAY<DOUBLE>")


def exact(table, k):
    out = {}
    models = {}
    for r in table.collect():
        models.setdefault((r["group"], r.seed), []).append((r.word, np.array(r.vector)))
    for model, rows in models.items():
        rows = [(w, v / np.linalg.norm(v)) for w, v in rows if np.linalg.norm(v) > 0]
        units = np.array([v for _, v in rows])
        cosines = np.round(units @ units.T, 9)
        for i, (word, _) in enumerate(rows):
            order = sorted((j for j in range(len(rows)) if j != i),
                           key=lambda j: (-cosines[i, j], rows[j][0]))
            out[model, word] = [(rows[j][0], cosines[i, j]) for j in order[:k]]
    return out


def found(table, k, forest):
    out = {}
    for r in nearest.nearest_words(table, k, forest).orderBy("rank").collect():
        out.setdefault(((r["group"], r.seed), r.word), []).append((r.neighbour, r.similarity))
        assert r["rank"] == len(out[(r["group"], r.seed), r.word])
    return out


def test_one_leaf_is_exact(spark):
    table = vector_table(spark, 60)
    assert found(table, 5, nearest.Forest(trees=1, leaf=100)) == exact(table, 5)


def test_recall_with_small_leaves(spark):
    table = vector_table(spark, 400)
    got, want = found(table, 10, nearest.Forest(trees=20, leaf=40)), exact(table, 10)
    hits = sum(len({w for w, _ in got[k]} & {w for w, _ in want[k]}) for k in want)
    assert set(got) == set(want) and hits >= 0.9 * sum(map(len, want.values()))
    cosines = {(k, w): s for k, row in want.items() for w, s in row}
    assert all(s == pytest.approx(cosines[k, w], abs=1e-8)
               for k, row in got.items() for w, s in row if (k, w) in cosines)


def test_leaves_hold_every_word_once_a_tree_and_no_more_than_they_may(spark):
    table = vector_table(spark, 300, groups=("mid",))
    forest = nearest.Forest(trees=3, leaf=25)
    units = table.withColumn("unit", F.col("vector"))
    leaves = nearest._leaves(nearest._codes(units, ["group", "seed"], 12, forest),
                             ["group", "seed"], forest)
    sizes = [r["count"] for r in leaves.groupBy("tree", "depth", "prefix", "part").count().collect()]
    assert max(sizes) <= 25 and sum(sizes) == 900
    assert leaves.groupBy("tree", "word").count().where("count > 1").isEmpty()


def test_equal_and_zero_vectors(spark):
    rows = [("mid", 1, f"e{k}", [1.0, 2.0]) for k in range(40)] + [
        ("mid", 1, "zero", [0.0, 0.0]), ("mid", 1, "other", [2.0, -1.0]), ("senior", 1, "lone", [1.0, 0.0])]
    table = spark.createDataFrame(rows, "group STRING, seed INT, word STRING, vector ARRAY<DOUBLE>")
    got = found(table, 3, nearest.Forest(trees=2, leaf=16))
    assert "zero" not in {w for _, w in got} | {w for row in got.values() for w, _ in row}
    assert all(s == 1 for k in range(40) for _, s in got[("mid", 1), f"e{k}"])
    assert (("senior", 1), "lone") not in got
    assert nearest.nearest_words(table.limit(0)).collect() == []
