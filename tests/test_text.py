import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexitilt.functions import text as tx


def column(spark, values, expr):
    df = spark.createDataFrame(list(enumerate(values)), "i INT, x STRING")
    return [r.v for r in df.select("i", expr(F.col("x")).alias("v")).orderBy("i").collect()]


def test_model_text_keeps_tech_tokens(spark):
    df = spark.createDataFrame([("C++ / C# Engineer", "Build Node.js APIs in .NET", None),
                                ("", None, "asp.net & react.js www.x.com/a b"), (None, None, None)],
                               "title STRING, description STRING, skills_desc STRING")
    rows = tx.add_text_columns(df).collect()
    assert rows[0].model_text == "cplusplus csharp engineer build nodejs apis in dotnet"
    assert rows[1].model_text == "aspdotnet and reactjs b"
    assert (rows[2].model_text, rows[2].token_count, rows[2].text_raw) == ("", 0, "")
    assert rows[0].title_description_fingerprint == hashlib.sha1(
        b"cplusplus csharp engineer||build nodejs apis in dotnet").hexdigest()
    parity = tx.add_text_columns(df, nan_parity=True).collect()
    assert parity[0].model_text == rows[0].model_text + " nan"
    assert parity[2].model_text == "nan nan nan"


# Inputs and what each function makes of them, written out.
NORMALISED = [
    ("C++ / C# Engineer", "cplusplus csharp engineer"),
    ("Build Node.js APIs in .NET", "build nodejs apis in dotnet"),
    ("R&D & more", "r and d and more"),
    ("see https://a.b/c?x=1 now www.x.com/a b", "see now b"),
    ("Mañana 12 3rd", "ma ana 12 3rd"), ("x_y - z", "x y z"), ("A\nB\tC", "a b c"), ("", ""),
]
FOR_EMBEDDINGS = [
    ("Male and Female staff, 5 to 10 years", "and staff 5 to 10"),
    ("PhD or MBA, node.js c++ c#", "or node.js c++ c#"), ("http://x.y/z end", "end"),
    ("a_b-c", "a_b-c"), ("éms", "ms"), ("é ms", ""), ("Both shifts", "shifts"), ("", ""),
]
LETTERS_ONLY = [("Build Node.js 2 APIs! http://a.b/c", "build node js apis"), ("", "")]
WITHOUT_NUMBERS = [("Req 12 for 3rd & C#", "req for 3rd and csharp"), ("12 34", "")]
TOKENS = [
    (tx.whitespace_tokens, " a  b\nc ", ["a", "b", "c"]), (tx.whitespace_tokens, "", []),
    (tx.letter_tokens, "Ab_c 1d", ["ab_c", "d"]),
    (lambda c: tx.tech_tokens(tx.clean_for_embeddings(c)), "Node.js c++ a 9x x-y", ["node.js", "x-y"]),
]


@pytest.mark.parametrize("function, pairs", [
    (tx.normalize_text, NORMALISED), (tx.clean_for_embeddings, FOR_EMBEDDINGS),
    (tx.clean_text, LETTERS_ONLY),
    (lambda c: tx.normalized_description(c, without_numbers=True), WITHOUT_NUMBERS)])
def test_texts_become_what_is_written(spark, function, pairs):
    assert column(spark, [x for x, _ in pairs], function) == [y for _, y in pairs]


@pytest.mark.parametrize("function, value, tokens", TOKENS)
def test_tokens_are_what_is_written(spark, function, value, tokens):
    assert column(spark, [value], function) == [tokens]


words = st.sampled_from(["c++", "C#", ".NET", "asp.net", "https://a.b/c", "www.x", "male", "years",
                         "ms", "éms", "mañana", "12", "3rd", "&", "\n", "\x1c", "node.js", "x_y", "-",
                         "phd", "Both", "ß", "a.b", "http:x y"])
texts = st.lists(st.one_of(words, st.text("abz .,#+-_0\t", max_size=4)), max_size=12).map(" ".join)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(texts, min_size=60, max_size=120))
def test_normal_form_is_stable_and_plain(spark, values):
    once = column(spark, values, tx.normalize_text)
    assert column(spark, once, tx.normalize_text) == once
    assert all(re.fullmatch(r"([a-z0-9]+( [a-z0-9]+)*)?", x) for x in once)
    assert column(spark, once, lambda c: tx.single_spaced_count(c)) == [
        x.count(" ") + 1 if x else 0 for x in once]
    numberless = column(spark, values, lambda c: tx.normalized_description(c, without_numbers=True))
    assert not any(w.isdigit() for x in numberless for w in x.split(" "))
    assert all(re.fullmatch(r"([a-z]+( [a-z]+)*)?", x)
               for x in column(spark, values, tx.clean_text))


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["male", "Female", "both", "years", "phd", "MBA", "team",
                                          "node.js", "c++"]), max_size=9).map(" ".join),
                min_size=40, max_size=60))
def test_no_leak_word_is_left(spark, values):
    left = [w for x in column(spark, values, tx.clean_for_embeddings) for w in x.split()]
    assert set(left) <= {"team", "node.js", "c++"}


def test_whole_text_is_used(spark):
    long = "word " * 50_000 + "C++"
    assert column(spark, [long], tx.normalize_text)[0].endswith("word cplusplus")
    assert len(column(spark, [long], tx.whitespace_tokens)[0]) == 50_001


def test_complete_rows(spark):
    df = spark.createDataFrame([("a", "b"), (None, "c"), ("d", None)], "x STRING, y STRING")
    assert tuple(tx.complete_row_counts(df, ["x", "y"]).first()) == (3, 1, 2)
