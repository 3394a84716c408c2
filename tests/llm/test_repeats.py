import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexitilt.llm import repeats

SCHEMA = "doc_id long, text string"


def brute(rows, depth):
    """id, bytes, removed, runs and what is left, by counting every string."""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[k:k + depth] for _, d in data for k in range(len(d) - depth + 1))
    out = []
    for i, d in data:
        gone = np.zeros(len(d) + 1, bool)
        for k in range(len(d) - depth + 1):
            if seen[d[k:k + depth]] > 1:
                gone[k:k + depth] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((i, len(d), int(gone.sum()), runs,
                    bytes(b for b, g in zip(d, gone) if not g)))
    return sorted(out, key=repr)


def check(spark, rows, depth, partitions=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions).withColumns(
        {c: F.lit("clash") for c in ("id", "kept", "gram", "first", "salt", "id_key")})
    got = sorted(((r.id, len(r.kept) + sum(s.stop - s.first for s in r.spans),
                   sum(s.stop - s.first for s in r.spans), len(r.spans), bytes(r.kept))
                  for r in repeats.without_repeats(df, depth).collect()), key=repr)
    assert got == brute(rows, depth)
    return got


@pytest.mark.parametrize("depth,letters", [(4, "ab"), (7, "abc"), (16, "ab"), (40, "abcd")])
def test_random_texts_equal_counting(spark, depth, letters):
    draw = random.Random(depth)
    text = lambda n: "".join(draw.choice(letters) for _ in range(n))
    passages = [text(depth + k) for k in (-1, 0, 1, 5, 3 * depth)]
    rows = []
    for k in range(60):
        parts = [text(draw.randrange(0, 6 * depth // len(letters)))]
        for _ in range(draw.randrange(3)):
            parts += [draw.choice(passages), text(draw.randrange(depth))]
        rows.append((k, "".join(parts)))
    got = check(spark, rows, depth)
    assert any(r[2] for r in got)


def test_copies_near_copies_and_shared_passages(spark):
    draw = random.Random(1)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage, line = text(200), text(60), text(30)
    rows = [(k, base) for k in range(8)]
    for k in range(8, 30):
        words = base.split()
        for p in draw.sample(range(len(words)), 2):
            words[p] = word()
        rows.append((k, " ".join(words)))
    rows += [(k, f"{text(50)} {passage} {text(draw.randrange(40))}") for k in range(30, 50)]
    rows += [(k, f"{text(60)}\n{line}\n{text(20)}") for k in range(50, 80)]  # under the depth
    rows += [(k, text(100)) for k in range(80, 90)]
    got = check(spark, rows, repeats.DEPTH)
    assert {r[0] for r in got if not r[2]} >= set(range(80, 90))


def test_odd_rows(spark):
    long = "ab" * 30_000
    rows = [(1, None), (2, ""), (3, "x" * 199), (4, "x" * 200), (5, "é" * 150), (6, "é" * 99 + "ü" * 60),
            (None, "same text " * 30), (7, "short"), (7, "short"), (8, "y" * 4000 + "z"), (9, long),
            (10, "row twice " + "q" * 250 + "w"), (10, "row twice " + "q" * 250 + "w"),
            (11, "line one that is long enough to count\n" * 12), (12, "日本語" * 40)]
    check(spark, rows, repeats.DEPTH)


def of_texts(*texts, depth=200):
    data = np.frombuffer(b"".join(texts), np.uint8)
    return repeats.runs_of(data, np.cumsum([len(t) for t in texts]), depth)


def starts_of(runs):
    return sorted((k, int(p)) for f, e, p, *_ in zip(*runs) for k in range(f, e + 1))


def test_blocks_of_a_long_text_change_nothing(spark, monkeypatch):
    draw = random.Random(4)
    whole = "".join(draw.choice("abcdef ") for _ in range(3000))
    texts = (whole + "x" + whole[500:1900]).encode(), b"short", whole[:700].encode(), b"z" * 200
    plain = starts_of(of_texts(*texts))
    monkeypatch.setattr(repeats, "_BLOCK", 257)
    assert starts_of(of_texts(*texts)) == plain
    ends = np.cumsum([0, *map(len, texts)])
    assert [k for k, _ in plain] == [k for a, t in zip(ends, texts) for k in range(a, a + len(t) - 199)]
    check(spark, [(k, t.decode()) for k, t in enumerate(texts)], 200)


def test_equal_strings_have_equal_landmarks():
    draw = random.Random(2)
    middle = "".join(draw.choice("abc") for _ in range(400)).encode()
    place = lambda runs, shift: {k - shift: (int(p) - k, int(g)) for f, e, p, g, *_ in zip(*runs)
                                 for k in range(f, e + 1)}
    first = place(of_texts(b"left" * 30 + middle + b"right"), 120)
    second = place(of_texts(middle + b"other" * 50), 0)
    assert all(first[k] == second[k] for k in range(201))


def test_digits_of_equal_bytes_are_equal():
    draw = random.Random(9)
    middle = "".join(draw.choice("abcdefgh") for _ in range(2000)).encode()
    a, b = of_texts(b"p" * 300 + middle + b"q" * 300), of_texts(b"other", b"r" * 250 + middle)
    digits = lambda runs, shift: {int(f) - shift: tuple(map(int, (e - f, p - f, g, w, r, x)))
                                  for f, e, p, g, w, r, x in zip(*runs)}
    first, second = digits(a, 300), digits(b, 255)
    inner = [k for k in first if 200 < k < 1400]
    assert len(inner) > 5 and all(first[k] == second[k] for k in inner)


def test_empty_table_and_digest_columns(spark):
    empty = repeats.removed_repeats(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == []
    rows = [(1, "k" * 300), (2, "unlike")]
    got = {r.doc_id: r for r in repeats.removed_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1].n_bytes, got[1].n_removed, got[1].n_spans) == (300, 300, 1)
    assert got[1].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[2].kept_sha256 == hashlib.sha256(b"unlike").hexdigest() and got[2].n_spans == 0
