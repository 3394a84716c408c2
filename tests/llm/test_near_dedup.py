import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexitilt.llm import near_dedup as nd

SCHEMA = "doc_id long, text string"


def brute_fingerprint(text):
    words = [w for w in "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in " \t\n\x0b\x0c\r" else c
        for c in text or "").split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, distance=4):
    """rows: (id, fingerprint); the smallest id reachable for each row."""
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, (_, f) in enumerate(rows):
            for j, (_, g) in enumerate(rows):
                if (f ^ g).bit_count() <= distance and label[j] < label[i]:
                    label[i], changed = label[j], True
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(label[k], []).append(i)
    return [min((x for x in ids[label[k]] if x is not None), default=None)
            for k in range(len(rows))]


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumns(
        {"fingerprint": F.lit("clash"), "component_id": F.lit(-1), "fp": F.lit(0)})
    got = nd.near_duplicates(df, **options).collect()
    marked = [(i, brute_fingerprint(t)) for i, t in rows]
    want = sorted(zip((i if i is not None else -1 for i, _ in rows),
                      (f"{f:016x}" for _, f in marked), brute_components(marked)), key=repr)
    assert sorted(((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id)
                   for r in got), key=repr) == want


def near_copies(n, seed):
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 500, 300)]
    out = []
    for _ in range(n):
        copy = list(base)
        for p in rng.integers(0, 300, rng.integers(0, 5)):
            copy[p] = f"x{rng.integers(0, 9)}"
        out.append(" ".join(copy))
    return out


def test_links_equal_brute_force_on_odd_rows(spark):
    texts = [None, "", " \t\n", "One", "one", "ONE two three", "a b c d", "A\tb\nC  d", "é É é É é",
             "long " * 3000, *near_copies(12, 1), *near_copies(4, 2)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(7, texts[7]), (None, "one"), (None, None)]
    check(spark, rows)


def test_lists_over_the_limit_lose_no_link(spark):
    rows = [(k, t) for k, t in enumerate(near_copies(25, 3) + near_copies(10, 4))]
    check(spark, rows, max_list=3)


def test_empty_table(spark):
    assert nd.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_any_two_within_four_bits_share_a_key_and_a_ball_value():
    masks, ball = nd.position_masks(), nd.ball_masks()
    assert len(masks) == 70 and len(ball) == 1 + 64 + 64 * 63 // 2
    rng = np.random.default_rng(5)
    for _ in range(200):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(flips & m & (2 ** 64 - 1) == 0 for m in masks)
    assert max((m & (2 ** 64 - 1)).bit_count() for m in ball) == 2


def test_spanning_forest_joins_a_chain():
    chain = np.cumsum([0] + [0b1111 << (4 * k) for k in range(6)]).astype(np.int64)
    edges = nd.spanning_forest(chain)
    assert len(edges) == 6 and {a for a, _ in edges} == {0}


@pytest.mark.parametrize("n", [1, 2, 7])
def test_components_of_chains_and_stars(spark, n):
    edges = [(10 * c + k, 10 * c + k + 1) for c in range(n) for k in range(8)] + [(500, 3)]
    got = {r.node: r.root for r in
           nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {10 * c + k: 10 * c for c in range(n) for k in range(1, 9)} | {500: 0}


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d e", "x"), (1, "A b c d e", "y"), (2, "q r s t", None), (2, "q r s t", None),
            (None, "a b c d e", "z")]
    kept = nd.keep_one_each(spark.createDataFrame(rows, SCHEMA + ", component_id string")).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 2]
    assert {r.component_id for r in kept if r.doc_id == 1} == {"y"}


def test_texts_of_one_id_are_copies_only_if_they_are_near(spark):
    rows = [(5, "a b c d e", "x"), (5, "p q r s t u", "y"), (5, "p q r s t u", "z"), (9, None, "n"),
            (8, "", "m"), (8, "long " * 50_000, "l")]
    kept = nd.keep_one_each(spark.createDataFrame(rows, SCHEMA + ", mark string")).collect()
    assert sorted(r.doc_id for r in kept) == [5, 5, 8, 8]
    chosen = {r.text for r in kept}
    assert len(chosen) == 4 and chosen <= {t for _, t, _ in rows}
    assert nd.keep_one_each(spark.createDataFrame([], SCHEMA)).collect() == []


def test_kept_documents_are_the_first_of_each_group(spark):
    rows = list(enumerate(near_copies(15, 6) + near_copies(9, 7) + ["alone in the world", None, ""]))
    marked = [(i, brute_fingerprint(t)) for i, t in rows]
    kept = nd.keep_one_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in kept} == set(brute_components(marked))
