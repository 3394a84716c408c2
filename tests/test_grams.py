import numpy as np
import pytest

from lexitilt.operators import grams, vectors

WORDS = ["lead", "leader", "leading", "leaders", "manage", "manager", "managing", "team", "teams",
         "teamwork", "work", "worker", "working", "care", "caring", "caregiver", "a", "of"]


def word_table(spark, size=5, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(g, s, w, 3 + len(w), rng.normal(size=size).tolist()) for g in ("mid", "senior")
            for s in (7, 17) for w in WORDS[:len(WORDS) - (g == "senior")]]
    return spark.createDataFrame(
        rows, "group STRING, seed INT, word STRING, n BIGINT, vector ARRAY<DOUBLE>")


def parts(word, config):
    marked = f"<{word}>"
    found = list(dict.fromkeys(marked[i:i + n] for n in range(config.min_n, config.max_n + 1)
                               for i in range(len(marked) - n + 1)))
    return found or [marked]


def test_gram_vectors_solve_the_ridge_problem(spark):
    config = grams.Ridge(vector_size=5, buckets=1 << 40, ridge=0.1, steps=14, block_words=4)
    table = word_table(spark)
    fitted = grams.fit(table, config)
    made = {(r["group"], r.seed, r.word): r.vector
            for r in grams.composed(fitted, table).collect()}
    for group in ("mid", "senior"):
        for seed in (7, 17):
            rows = [r for r in table.collect() if (r["group"], r.seed) == (group, seed)]
            names = sorted({g for r in rows for g in parts(r.word, config)})
            m = np.zeros((len(rows), len(names)))
            for i, r in enumerate(rows):
                for g in parts(r.word, config):
                    m[i, names.index(g)] += 1 / len(parts(r.word, config))
            x = np.array([r.vector for r in rows])
            z = np.linalg.solve(m.T @ m + 0.1 * np.eye(len(names)), m.T @ x)
            for i, r in enumerate(rows):
                assert made[group, seed, r.word] == pytest.approx((m @ z)[i], abs=1e-3)
    assert len(made) == table.count()  # the coverage stays what it was
    left = [r.residual for r in fitted.residuals.where("step = 13").collect()]
    assert len(left) == 4 and max(left) < 1e-4


def test_solved_grams_come_nearer_to_the_words_than_means_do(spark):
    config = grams.Ridge(vector_size=5, steps=8)
    table = word_table(spark)
    solved = grams.composed(grams.fit(table, config), table)
    means = vectors.compose_subwords(table, vector_size=5)
    by_model = {(r["group"], r.seed): r for r in grams.reconstruction(solved, table).collect()}
    for r in grams.reconstruction(means, table).collect():
        assert by_model[r["group"], r.seed].error < 0.5 * r.error
        assert by_model[r["group"], r.seed].words == r.words


def test_buckets_may_be_shared(spark):
    config = grams.Ridge(vector_size=5, buckets=7, steps=7)
    table = word_table(spark)
    fitted = grams.fit(table, config)
    assert fitted.vectors.select("bucket").distinct().count() == 7
    residuals = [r.residual for r in fitted.residuals.where("seed = 7 and group = 'mid'")
                 .orderBy("step").collect()]
    assert residuals[-1] < 0.05


def test_empty_table(spark):
    fitted = grams.fit(word_table(spark).limit(0), grams.Ridge(vector_size=5, steps=1))
    assert fitted.vectors.collect() == [] and fitted.residuals.collect() == []


def test_steps_give_back_the_state_before_them(spark, monkeypatch):
    written = []
    write = grams.materialize

    def noted(df, name="stage"):
        out = write(df, name)
        if name == "state":
            written.append(out.inputFiles()[0].rsplit("/", 1)[0])
        return out

    monkeypatch.setattr(grams, "materialize", noted)
    fitted = grams.fit(word_table(spark), grams.Ridge(vector_size=5, steps=3))
    assert [spark.read.parquet(p).count() > 0 for p in written] == [False, False, False, True]
    assert fitted.vectors.count() > 0
