import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexitilt.functions.vector_math import cosine
from lexitilt.operators import corpus, vectors


@pytest.fixture(scope="module")
def texts():
    random.seed(11)
    vocab = ["he", "she", "career", "home", "the", "of", "data", "lead", "kind", "café", "x1"]
    docs = [("mid", [random.choice(vocab) for _ in range(random.randrange(0, 30))]) for _ in range(40)]
    docs += [("senior", [random.choice(vocab[:6]) for _ in range(12)]) for _ in range(20)]
    docs.append(("mid", ["the"] * 700))  # one word holds a third of the corpus
    return docs


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, "group STRING, tokens ARRAY<STRING>")


def test_corpus_stats(docs, texts):
    rows = {r["group"]: r for r in corpus.with_min_counts(corpus.corpus_stats(docs)).collect()}
    for group in ("mid", "senior"):
        full = [t for g, t in texts if g == group and t]
        assert rows[group].docs == len(full)
        assert rows[group].tokens == sum(map(len, full))
        assert rows[group].vocab_size == len({w for t in full for w in t})
        assert rows[group].avg_doc_len == pytest.approx(sum(map(len, full)) / len(full))
    meta = {(r["group"], r.seed): r for r in corpus.training_metadata(docs).collect()}
    assert len(meta) == 6
    assert meta["mid", 7].documents == 41 and meta["mid", 7].sentences == rows["mid"].docs


@pytest.mark.parametrize("n,vocab,plain,synthetic", [
    (499, 9999, 1, 1), (500, 9999, 2, 2), (1500, 9999, 3, 2), (2000, 4999, 3, 2),
    (5000, 9999, 5, 5), (10, 10, 1, 1)])
def test_min_counts(spark, n, vocab, plain, synthetic):
    df = spark.createDataFrame([(n, vocab)], "docs LONG, vocab_size LONG")
    row = corpus.with_min_counts(df).first()
    assert (row.min_count, row.min_count_synthetic) == (plain, synthetic)


def test_top_words_and_leakage(docs, texts):
    rows = corpus.top_words(docs, 3).collect()
    counts = Counter(w for g, t in texts if g == "mid" for w in t)
    best = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:3]
    assert sorted((r["rank"], r.word, r.n) for r in rows if r["group"] == "mid") == [
        (i + 1, w, n) for i, (w, n) in enumerate(best)]
    found = {(r["group"], r.word): r.present for r in corpus.leakage_check(docs, ["x1", "he"]).collect()}
    assert found == {("mid", "x1"): True, ("mid", "he"): True, ("senior", "x1"): False, ("senior", "he"): True}


def brute_ppmi(texts, group, window=5):
    pairs, near = Counter(), Counter()
    for g, tokens in texts:
        if g == group:
            for i, w in enumerate(tokens):
                for j in range(max(0, i - window), min(len(tokens), i + window + 1)):
                    if i != j:
                        pairs[w, tokens[j]] += 1
                        near[w] += 1
    total = sum(near.values())
    return {k: v for k, v in ((k, math.log(n * total / (near[k[0]] * near[k[1]])))
                              for k, n in pairs.items()) if v > 1e-12}


@pytest.mark.parametrize("listed", [None, ["he", "career", "missing"]])
def test_ppmi_matches_brute_force(docs, texts, listed):
    cells = vectors.ppmi_vectors(docs, listed).cells.collect()
    for group in ("mid", "senior"):
        expected = {k: v for k, v in brute_ppmi(texts, group).items() if not listed or k[0] in listed}
        got = {(r.word, r.ctx): r.weight for r in cells if r["group"] == group and r.weight > 1e-12}
        assert got == pytest.approx(expected)


def test_neighbours_match_brute_force(docs, texts):
    found = vectors.neighbours(vectors.ppmi_vectors(docs).saved(), ["he", "absent"], 4).collect()
    assert {r["query"] for r in found} == {"he"}
    cells = brute_ppmi(texts, "senior")
    words = sorted({w for w, _ in cells})
    rows = {w: np.array([cells.get((w, c), 0.0) for c in words]) for w in words}
    sims = {w: rows[w] @ rows["he"] / (np.linalg.norm(rows[w]) * np.linalg.norm(rows["he"]))
            for w in words if w != "he"}
    got = {r.word: r.similarity for r in found if r["group"] == "senior"}
    best = sorted(sims.values(), reverse=True)[:4]
    assert sorted(got.values(), reverse=True) == pytest.approx(best, abs=1e-6)


def test_dense_vectors_are_seeded_and_keep_angles(docs):
    sparse = vectors.ppmi_vectors(docs).saved()
    table = vectors.dense_vectors(sparse, [7, 17], 600).cache()
    again = vectors.dense_vectors(sparse, [7], 600).orderBy("group", "word").collect()
    assert again == table.filter("seed = 7").orderBy("group", "word").collect()
    both = {s: table.filter(f"seed = {s} AND group = 'mid'").select("word", "vector").collect() for s in (7, 17)}
    assert both[7] != both[17]
    exact = {(r.word, r.ctx): r.weight for r in sparse.cells.filter("group = 'mid'").collect()}
    contexts = sorted({c for _, c in exact})
    for rows in both.values():
        dense = {r.word: np.array(r.vector) for r in rows}
        a, b = (np.array([exact.get((w, c), 0.0) for c in contexts]) for w in ("he", "home"))
        assert dense["he"] @ dense["home"] == pytest.approx(
            a @ b, abs=4 * np.linalg.norm(a) * np.linalg.norm(b) / math.sqrt(600) + 1e-9)


def test_subwords(spark):
    df = spark.createDataFrame([("cat",), ("a",), ("ñu",)], "w STRING")
    got = {r.w: r.g for r in df.select("w", vectors.subwords(F.col("w"), 3, 4).alias("g")).collect()}
    assert got == {"cat": ["<ca", "cat", "at>", "<cat", "cat>"], "a": ["<a>"], "ñu": ["<ñu", "ñu>", "<ñu>"]}


def test_compose_subwords(spark):
    table = spark.createDataFrame(
        [("g", 1, "ab", 3, [1.0, 0.0]), ("g", 1, "abc", 1, [0.0, 4.0]), ("g", 1, "zz", 1, [5.0, 5.0])],
        "group STRING, seed INT, word STRING, n LONG, vector ARRAY<DOUBLE>")

    def expected(word):
        rows = {r.word: (r.n, np.array(r.vector)) for r in table.collect()}
        grams = {w: {f"<{w}>"[i:i + 3] for i in range(len(w))} for w in rows}
        parts = [rows[word][1]]
        for gram in grams[word]:
            holders = [w for w in rows if gram in grams[w]]
            parts.append(sum(rows[w][0] * rows[w][1] for w in holders) / sum(rows[w][0] for w in holders))
        return sum(parts) / len(parts)

    full = {r.word: r.vector for r in vectors.compose_subwords(table, vector_size=2, min_n=3, max_n=3).collect()}
    some = vectors.compose_subwords(table, ["ab"], vector_size=2, min_n=3, max_n=3).collect()
    assert set(full) == {"ab", "abc", "zz"} and [r.word for r in some] == ["ab"]
    for word, vector in full.items():
        assert vector == pytest.approx(list(expected(word)))
    assert some[0].vector == pytest.approx(full["ab"])


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0], 0.8), ([0.0, 0.0], [1.0, 1.0], 0.0)],
                               "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>, e DOUBLE")
    for r in df.select(cosine(F.col("a"), F.col("b")).alias("c"), "e").collect():
        assert r.c == pytest.approx(r.e)


def test_each_pair_crosses_the_shuffle_once(spark):
    docs = spark.createDataFrame(
        [("a", "x y x x z".split()), ("a", ["y"]), ("b", "q x q w w w v u q".split()), ("b", [])],
        "group string, tokens array<string>")
    whole = vectors.cooccurrence_counts(docs, window=2)
    halved = vectors.halved_counts(docs, window=2)
    assert halved.filter("ctx < word").count() == 0
    assert {tuple(r) for r in vectors.both_ways(halved).collect()} == {
        tuple(r) for r in whole.filter("ctx is not null").select("group", "word", "ctx", "n").collect()}
    assert {tuple(r) for r in halved.filter("ctx is null").collect()} == {
        tuple(r) for r in whole.filter("ctx is null").collect()}


def test_sums_over_contexts_need_no_exchange_of_sums(spark):
    docs = spark.createDataFrame([("a", "x y x x z".split())], "group string, tokens array<string>")
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sparse = vectors.ppmi_vectors(docs, min_count_col=F.lit(1))
        sums = sparse.cells.groupBy("group", "word").agg(F.sum("weight"))
        sums.collect()
        plan = sums._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert "SortMergeJoin" in plan and "Exchange" not in plan.split("SortMergeJoin")[0]
