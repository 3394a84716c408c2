"""Language ID, quality classifier and toxicity: held-out accuracy and odd rows."""

import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from lexitilt.llm import language_id, quality_classifier, toxicity
from lexitilt.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
ODD = [(1001, None), (1002, ""), (1003, "12 34 !!"), (None, "the cat"), (1004, "ü" * 20000)]


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels")}


def crc(key):
    return zlib.crc32(str(key).encode())


def test_language_of_held_out_documents(spark, tables):
    truth = {r.doc_id: r.lang for r in tables["documents"].collect()}
    got = QUERIES["op4_language_id"](spark, FOLDER).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and truth[r.doc_id]]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_language_by_word_then_by_shrinking_pieces(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate(
        [("the cat the dog and the bird", "en"), ("der hund und die katze", "de")] * 6)]
    odd = [(k, t, None) for k, t in ODD] + [(2000, "dogs", None), (2001, "hunde", None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string") \
        .withColumns({"lang_pred": F.lit(1), "unit": F.lit("x")})
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert [got[k].lang_pred for k in (1001, 1002, 1003)] == ["und"] * 3
    assert got[1001].score == 0 and not got[None].held_out
    assert (got[None].lang_pred, got[2000].lang_pred, got[2001].lang_pred) == ("en", "en", "de")
    assert language_id.identify(df.where("doc_id < 0")).collect() == []
    assert {r.lang_pred for r in language_id.identify(df.where("lang is null")).collect()} == {"und"}


def by_hand(training, texts, orders=(4, 3, 2, 1)):
    """The method on whole tables held as dictionaries; languages and scores of ``texts``."""
    def cut(word, order):
        marked = f"_{word}_" if order > 1 else word
        return [marked[k:k + order] for k in range(len(marked) - order + 1)]

    def logs(counts):
        units = {u for u, _ in counts}
        totals = [sum(n for (_, x), n in counts.items() if x == lang) for lang in langs]
        return {u: np.array([np.log((counts.get((u, x), 0) + 0.5) / (t + 0.5 * len(units) + 1))
                             for x, t in zip(langs, totals)]) for u in units}

    langs = sorted({lang for _, lang in training})
    words = Counter((w, lang) for t, lang in training for w in regex.findall(r"\p{L}+", t.lower()))
    known = logs(words)
    pieces = {}
    for order in orders:
        counts = Counter()
        for (w, lang), n in words.items():
            for g in cut(w, order):
                counts[g, lang] += n
        pieces[order] = logs(counts)

    def row(word):
        if word in known:
            return known[word]
        for order in orders:
            if found := [pieces[order][g] for g in cut(word, order) if g in pieces[order]]:
                return np.mean(found, axis=0)
        return np.zeros(len(langs))

    for text in texts:
        found = regex.findall(r"\p{L}+", (text or "").lower())
        if not found:
            yield "und", 0.0
            continue
        total = np.round(sum(row(w) for w in found), 6)
        best = int(total.argmax())
        yield langs[best], 1 / np.exp(total - total[best]).sum()


@pytest.mark.parametrize("frequent", [1, 40, 100_000])
def test_language_equals_the_method_by_hand(spark, tables, frequent):
    docs = tables["documents"].where("doc_id < 160").select("doc_id", "text", "lang") \
        .unionByName(spark.createDataFrame(
            [(9001, "½ ² Ⅷ ①", "en"), (9002, None, "de"), (9003, "x½y zzqj", None),
             (9004, "", None), (9005, "漢字漢字", None)], "doc_id long, text string, lang string"))
    rows = docs.collect()
    training = [(r.text, r.lang) for r in rows if crc(r.doc_id) % 4 != 2 and r.lang and r.text]
    want = dict(zip([r.doc_id for r in rows], by_hand(training, [r.text for r in rows])))
    got = language_id.identify(docs, language_id.Settings(frequent=frequent)).collect()
    assert len(got) == len(rows) and len({w for t, _ in training for w in t.split()}) > 40
    assert {r.doc_id: r.lang_pred for r in got} == {k: v[0] for k, v in want.items()}
    assert all(abs(r.score - want[r.doc_id][1]) < 1e-5 for r in got)
    assert want[9001] == ("und", 0.0)


def test_language_of_equal_sums_and_repeated_rows(spark):
    rows = [(k, "same words", lang) for k, lang in enumerate(["b", "a"] * 8) if crc(k) % 4 != 2]
    even = min(sum(x == "a" for *_, x in rows), sum(x == "b" for *_, x in rows))
    rows = [r for x in "ab" for r in [r for r in rows if r[2] == x][:even]]
    docs = spark.createDataFrame(rows + rows[:1] * 2, "doc_id long, text string, lang string")
    once = language_id.identify(docs.dropDuplicates()).collect()
    assert {(r.lang_pred, r.score) for r in once} == {("a", 0.5)}
    assert language_id.identify(docs).count() == len(rows) + 2


def test_language_labels_of_the_held_out_fold_are_not_learnt(spark):
    held = [k for k in range(200) if crc(k) % 4 == 2]
    rows = [(k, "alpha beta gamma", "xx" if k in held else "yy") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.identify(df).collect()} == {"yy"}


def test_quality_of_held_out_documents(spark, tables):
    labels = {r.doc_id: r.quality for r in tables["labels"].collect()}
    got = QUERIES["op10_quality_classifier"](spark, FOLDER).collect()
    assert len(got) == tables["documents"].count()
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1
               and r.predicted == (r.score >= 0.3) for r in got)
    held = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.93
    assert np.mean([b for a, b in held if a == 1]) > 0.97


def test_quality_of_odd_rows(spark, tables):
    schema = "doc_id long, text string"
    settings = quality_classifier.Settings(epochs=5)
    docs = spark.createDataFrame(ODD + [(7, "good words here"), (7, "good words here")], schema) \
        .withColumns({"score": F.lit("x"), "token": F.lit(1)})
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_classifier.train(docs, none, settings)
    got = quality_classifier.score(docs, model, settings).collect()
    assert sorted(r.score for r in got if r.doc_id in (1001, 1002)) == [0, 0]
    assert {r.score for r in got if r.doc_id == 7} == {0.5} and len(got) == 7
    one = spark.createDataFrame([(7, 1), (7, 1), (None, 0), (1002, None)], "doc_id long, quality int")
    model = quality_classifier.train(docs, one, settings)
    kept = quality_classifier.keep_good(docs, model, settings)
    assert kept.columns == docs.columns and 7 in {r.doc_id for r in kept.collect()}
    assert quality_classifier.score(docs.limit(0), model, settings).collect() == []


def pooled(texts, sums, settings):
    return quality_classifier.pooled(
        texts, quality_classifier.Reader(),
        quality_classifier.Grown(settings.size, np.float32), sums, settings)


def pooled_by_hand(texts, settings):
    """Bucket sums over ``texts`` and each text's pooled row, a token and a coordinate at a time."""
    def index(token):
        return quality_classifier.index_vectors(
            np.array([quality_classifier.marks_of(token)], np.uint64), settings)[0]

    def at(token):
        own, shape = quality_classifier.marks_of(token)
        return [(own >> 32) % settings.buckets, own % 2 ** 32 % settings.buckets,
                shape % settings.buckets]

    def unit(x):
        return x / max(np.linalg.norm(x), 1e-9)

    cut = [regex.findall(quality_classifier.TOKEN, t or "") for t in texts]
    sums = np.zeros((settings.buckets, settings.size))
    for tokens in cut:
        for i, t in enumerate(tokens):
            near = [j for j in range(max(0, i - settings.reach), i + settings.reach + 1)
                    if j != i and j < len(tokens)]
            for place in at(t):
                sums[place] += sum((index(tokens[j]) for j in near), np.zeros(settings.size))
    out = []
    for tokens in cut:
        if not tokens:
            out.append(None)
            continue
        x = np.array([(unit(sums[p] + sums[q]) + unit(sums[r])) / 2 for p, q, r in map(at, tokens)])
        follow = [a * b for a, b in zip(x, x[1:])]
        out.append(np.concatenate([x.mean(axis=0), x.std(axis=0),
                                   np.mean(follow, axis=0) if follow else np.zeros(settings.size)]))
    return sums, out


@pytest.mark.parametrize("buckets", [7, 1 << 16])
def test_pooled_vectors_equal_the_method_by_hand(spark, buckets):
    settings = quality_classifier.Settings(buckets=buckets, size=6, nonzero=2)
    texts = ["the cat, the dog!", "the bird", "", None, "one", "漢字 the dog dog dog 12-34",
             "Ω " * 50 + "end", "the cat, the dog!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want, rows = pooled_by_hand(texts, settings)
    sums = quality_classifier.bucket_sums(docs.where("text is not null"), settings)
    assert np.array_equal(sums, want)
    got = pooled(texts, sums, settings)
    for x, y in zip(got, rows):
        assert np.isnan(x).all() if y is None else np.allclose(x, y, atol=1e-3)


def test_every_token_has_a_vector_of_its_own():
    settings = quality_classifier.Settings()
    marks = np.array([quality_classifier.marks_of(f"w{k}") for k in range(400_000)], np.uint64)
    first, second, _ = quality_classifier.places(marks, settings)
    pairs = np.unique(first * settings.buckets + second)
    assert len(marks) > settings.buckets and len(pairs) > 0.9999 * len(marks)
    drawn = quality_classifier.index_vectors(marks, settings)
    assert abs(drawn.mean()) < 1e-3 and np.all(np.abs(drawn).sum(axis=1) <= settings.nonzero)


def test_chunks_forget_no_text(monkeypatch):
    texts = [f"a{k} b{k} a{k % 3}" if k % 4 else None for k in range(100)]
    settings = quality_classifier.Settings(size=6)
    sums = np.random.default_rng(0).normal(size=(settings.buckets, 6))
    whole = pooled(texts, sums, settings)
    learnt = quality_classifier.task_sums(iter([texts[:30], texts[30:]]), settings)
    monkeypatch.setattr(quality_classifier, "_CHUNK", 10)
    monkeypatch.setattr(quality_classifier, "_CACHE", 25)
    parts = pooled(texts, sums, settings)
    assert np.allclose(whole, parts, atol=1e-5, equal_nan=True)
    assert learnt.any() and np.array_equal(
        learnt, quality_classifier.task_sums(iter([texts]), settings))


def test_toxic_documents_stand_out(spark):
    documents, rows = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
                       for t in ("documents", "labels"))
    labels = {r.doc_id: r.toxic for r in rows.collect()}
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = toxicity.train(documents, rows.where(fold > 0))
    got = toxicity.severity(documents, model).collect()
    held = [(labels[r.doc_id], r.toxic) for r in got
            if r.doc_id in labels and crc(r.doc_id) % 3 == 0]
    assert np.mean([b for a, b in held if a]) > 0.85
    assert np.mean([b for a, b in held if not a]) < 0.02
    assert list(model.thresholds) == sorted(model.thresholds)
    assert all(0 <= r.expected_severity <= 3 and r.toxic == (r.p_toxic >= 0.5) for r in got)


def test_severity_grows_with_grades(spark):
    rows = [(k, " ".join(["calm words"] * 4 + ["bad"] * (k % 4) + ["worse"] * (k % 4 // 2)))
            for k in range(400)]
    labels = spark.createDataFrame([(k, k % 4) for k in range(400)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows + ODD, "doc_id long, text string") \
        .withColumns({"grade": F.lit("x"), "label": F.lit(9)})
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.severity(docs, model).collect()}
    means = [np.mean([got[k].expected_severity for k in range(g, 400, 4)]) for g in range(4)]
    assert means == sorted(means) and means[3] > means[0] + 1
    assert got[1001].expected_severity == got[1002].expected_severity


def test_grades_with_few_texts_do_not_drive_the_fit_away():
    grades = np.repeat([0, 1, 2, 3], [4000, 40, 590, 1530])
    n, rng = len(grades), np.random.default_rng(1)
    common = rng.poisson(3, (n, 60))
    bad = np.stack([(grades > 0) * rng.poisson(1 + 2 * grades) for _ in range(3)], axis=1)
    counts = np.hstack([common, bad])
    r, c = np.nonzero(counts)
    settings = toxicity.Settings()
    model = toxicity.fit(list(range(63)), r, c, np.log1p(counts[r, c].astype(float)), grades, settings)
    weights = np.array([model.weights.get(f, 0.0) for f in range(63)])
    up = model.at_least(np.log1p(counts) @ weights)
    assert np.abs(model.thresholds).max() < 100
    assert (up[grades > 0, 0] >= 0.5).mean() > 0.9 and (up[grades == 0, 0] >= 0.5).mean() < 0.05


def test_toxicity_without_both_classes(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    for rows in ([], [(1002, 0)], [(1003, 1)], [(None, 1), (1003, None)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        assert toxicity.train(docs, labels) is None
    assert {(r.expected_severity, r.toxic) for r in toxicity.severity(docs, None).collect()} \
        == {(0.0, False)}
    assert toxicity.severity(docs.limit(0), None).collect() == []
