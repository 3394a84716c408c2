from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexitilt.llm import quality_rules as qr

SCHEMA = "doc_id long, text string, lang string"
BLANKS = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    words = "".join(" " if c in BLANKS else c for c in text).split(" ")
    words = [w for w in words if w]
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if any(c not in BLANKS for c in x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(inside))


TEXTS = [None, "", " \t\n", "one", "a b c d e", "a b c d e a b c d e", "x " * 40, "a b c d e f " * 3,
         "l one\nl one\n\n \nl one ", "#*$%&|<> 😀 é\x0bñ", "a\x0cb\x0bc\rd\te\nf g h i j k",
         "p q r s t u p q r s t v q r s t u", "word" * 30000, "ab cd ef gh ij " * 3000]


def test_base_metrics_equal_brute_force(spark):
    df = spark.createDataFrame([(k, t, None) for k, t in enumerate(TEXTS)], SCHEMA) \
        .withColumns({"n_chars": F.lit("x"), "classes": F.lit(1)})
    got = {r.doc_id: r for r in qr.apply_rules(df).collect()}
    for k, text in enumerate(TEXTS):
        r, want = got[k], brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_labelled_junk_goes_and_clean_documents_stay(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = qr.apply_rules(docs).join(labels, "doc_id").collect()
    fair = [r for r in got if not r.base_failed]
    assert len([r for r in fair if r.quality == 1 and r.kept]) \
        >= 0.99 * len([r for r in fair if r.quality == 1])
    bad = [r for r in got if r.quality == 0]
    assert len([r for r in bad if not r.kept]) >= 0.85 * len(bad)


def test_distance_of_known_pairs(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5])],
                               "p array<double>, q array<double>")
    got = [r[0] for r in df.select(qr.js_distance(F.col("p"), F.col("q"))).collect()]
    assert got == pytest.approx([1.0, 0.0])


def test_repeated_rows_unknown_languages_and_empty_table(spark):
    clean = " ".join(f"word{k % 70} and the other{k}" for k in range(120))
    rows = [(k, clean, "en") for k in range(30)] + [(90, clean, None), (90, clean, "zz")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = qr.apply_rules(df).collect()
    assert len(got) == 32 and len({(r.class_distance, r.word_distance) for r in got}) == 1
    assert all(r.kept for r in got)
    assert qr.apply_rules(df.limit(0)).collect() == []


def test_every_language_has_a_reference_of_its_own(spark):
    rows = [(100 * a + k, " ".join(f"l{a}w{(j * j + k) % 30}" for j in range(120)), f"x{a:02d}")
            for a in range(70) for k in range(20 + (a < 64))]
    got = qr.with_divergence(
        qr.with_base_metrics(df := spark.createDataFrame(rows, SCHEMA)),
        qr.references(df, qr.Rules()), qr.Rules()).select("doc_id", "word_distance").collect()
    assert len(got) == len(rows) and all(r.word_distance < 0.9 for r in got)


def test_a_thin_language_is_not_held_against_others(spark):
    text = lambda words, k: " ".join(words[(k * 7 + j * (k % 5 + 1)) % len(words)] for j in range(90)) + "."
    english = "the of and to in a is that it was for on are as with his they at be this house river".split()
    russian = "дом река лес город день ночь свет вода земля небо друг книга слово время год человек".split()
    rows = [(k, text(english, k), "en") for k in range(30)] + [
        (100 + k, text(russian, k), "ru") for k in range(5)] + [(200, text(russian, 9), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    rules = qr.Rules(max_repeat_percent=1000)
    got = {r.doc_id: r for r in qr.apply_rules(df, rules).collect()}
    assert len(got) == 36
    for k in range(5):
        assert got[100 + k].kept and got[100 + k].word_distance is None
    assert not got[200].kept and got[200].word_distance > 0.9
    assert got[3].word_distance is not None


@pytest.mark.parametrize("width", [1, 2, 3, 5, 6, 7])
def test_windows_of_any_width(spark, width):
    texts = ["a b c a b c a b", "x " * 9, "p q r s t u v p q r s t u w", "one"]
    words = [t.split() for t in texts]
    df = spark.createDataFrame([(w,) for w in words], "words array<string>")
    got = [r[0] for r in df.select(qr.repeated_window_words(F.col("words"), width)).collect()]
    for ws, n in zip(words, got):
        windows = [tuple(ws[k:k + width]) for k in range(len(ws) - width + 1)]
        often = Counter(windows)
        assert n == len({k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(width)})


def test_a_word_is_hashed_once_and_symbols_are_sought_in_the_swept_text(spark):
    df = spark.createDataFrame([(1, "É é # ß $x", "en")], SCHEMA)
    row = qr.with_base_metrics(df).first()
    assert row.left_0 == "É#$" and row.joined == "É é # ß $x" and row.n_symbols == 2
