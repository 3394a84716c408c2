from itertools import combinations

from pyspark.sql import functions as F

from lexitilt.llm import licenses as lic

SCHEMA = "doc_id long, text string"
MIT = "Released under the MIT License."
GPL = "This work is licensed under the GNU General Public License, version 3."


def test_longest_increasing_equals_brute_force():
    import random
    rng = random.Random(2)
    for _ in range(60):
        values = rng.sample(range(20), 8)
        best = max((len(c) for n in range(9) for c in combinations(range(8), n)
                    if all(values[a] < values[b] for a, b in zip(c, c[1:]))))
        got = lic.longest_increasing(values)
        assert len(got) == best and [values[k] for k in got] == sorted(values[k] for k in got)
    assert lic.longest_increasing([]) == []


def test_alignment_is_increasing_and_of_equal_words():
    template = lic.words_of(GPL)
    text = ["x", *template[:4], "a", "b", *template[4:9], "the", *template[9:], "y"]
    pairs = lic.patience(text, template)
    assert all(text[a] == template[b] for a, b in pairs)
    assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))
    assert len(pairs) == len(template)


def test_notices_in_long_repeated_and_changed_texts(spark):
    filler = "mit license the under gnu of " * 800
    rows = [(1, MIT), (2, f"{filler}\n{GPL}\n{filler}"), (3, f"{MIT} {MIT} {GPL}"), (4, None), (5, ""),
            (6, "Released under the BSD License."), (7, GPL.replace("work", "very fine work")),
            (8, "released UNDER the, MIT licence"), (9, "Licensed under CC BY-NC 4.0."),
            (10, "Licensed under CC BY 4.0."), (None, MIT), (1, MIT), (11, GPL.replace("3", "2"))]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"license": F.lit(3), "n": F.lit("x")})
    got = lic.scan_licenses(df).collect()
    names = {(r.doc_id, r.license, r.n_notices) for r in got}
    assert names >= {(1, "MIT", 1), (3, "MIT", 3), (4, None, 0), (5, None, 0), (6, None, 0),
                     (7, "GPL-3.0", 1), (8, None, 0), (9, "CC-BY-NC-4.0", 1), (10, "CC-BY-4.0", 1),
                     (None, "MIT", 1), (11, "GPL-2.0", 1)}
    assert len(got) == len(rows)
    long = next(r for r in got if r.doc_id == 2)
    assert "GPL-3.0" in {x.license for x in long.notices}
    assert lic.scan_licenses(df.limit(0)).collect() == []


def test_every_template_finds_itself():
    scanner = lic.Scanner()
    for name, _, text in lic.TEMPLATES:
        assert name in {x[0] for x in scanner.scan(f"before {text} after")}
