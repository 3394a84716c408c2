from collections import Counter

from pyspark.sql import functions as F

from lexitilt.llm import mixing as m

SCHEMA = "doc_id long, text string, source string"


def texts(n, words):
    return " ".join(f"w{k}" for k in range(n * 0 + words))


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100, 1001):
        df = spark.range(n).select(m.permuted(F.col("id"), F.lit(n).cast("long"),
                                              F.lit(5).cast("long"), 3).alias("y"))
        got = [r.y for r in df.collect()]
        assert sorted(got) == list(range(n))
        assert n < 100 or sum(k == y for k, y in enumerate(got)) < n // 10


def brute_targets(sizes, weights, share, cap):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target = {s: 0.0 for s in order}
    left, open_ = share * sum(sizes.values()), set(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * unit > cap * sizes[s]}
        if not over:
            target |= {s: weight[s] * unit for s in open_}
            break
        target |= {s: cap * sizes[s] for s in over}
        left -= sum(cap * sizes[s] for s in over)
        open_ -= over
    return target


def test_targets_share_the_excess():
    for sizes in ({"a": 100, "b": 5, "c": 900, None: 40}, {"a": 10}, {"B": 7, "a": 7, "é": 7}):
        plan = m.targets(sizes, m.Mix())
        want = brute_targets(sizes, (5, 2, 1), 1.5, 2)
        assert {r["source"]: round(r["target"], 9) for r in plan} \
            == {s: round(t, 9) for s, t in want.items()}
        assert abs(sum(r["target"] for r in plan) - 1.5 * sum(sizes.values())) < 1e-6


def test_taken_words_meet_targets_and_caps(spark):
    rows = [(k, texts(k, 20 + 37 * k % 200), ["hot", "hot", "b", "c", None][k % 5])
            for k in range(300)]
    rows += [(900, None, "b"), (901, "", "c"), (902, " \n\t", None), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"size": F.lit("x"), "rank": F.lit(1)})
    mix = m.Mix(block_words=16, shard_blocks=64, bucket_documents=10, bucket_group=4)
    first = m.taken_words(df, mix).collect()
    assert len(first) == len(rows)
    again = m.taken_words(df.repartition(3), mix).collect()
    assert Counter(first) == Counter(again)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    targets = brute_targets(dict(sizes), (5, 2, 1), 1.5, 2)
    got = Counter()
    for r in first:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert abs(r.target - targets[r.source]) < 1e-6
        got[r.source] += r.taken
    for s, t in targets.items():
        assert abs(got[s] - t) <= 16 + 0.01 * t


def test_mixture_is_made_of_the_blocks_of_the_streams(spark):
    rows = [(k, " ".join(f"{s}{k}_{j}" for j in range(9 + k % 5)), s)
            for s in ("a", "b") for k in range(40)]
    mix = m.Mix(block_words=8, shard_blocks=16, bucket_documents=7)
    out = m.mixture(spark.createDataFrame(rows, SCHEMA), mix).collect()
    plan = {r["source"]: r for r in m.targets(
        {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("a", "b")}, mix)}
    for s in ("a", "b"):
        mine = [r for r in out if r.source == s]
        assert sorted(r.slot for r in mine) == list(range(plan[s]["slots"]))
        blocks = {r.block: r.text for r in mine}
        times = Counter(r.block for r in mine)
        assert max(times.values()) - min(times.values()) <= 1 or len(blocks) < plan[s]["blocks"]
        assert all(len(r.text.split()) == r.n_words <= 8 for r in mine)
        if len(blocks) == plan[s]["blocks"]:
            words = Counter(w for t in blocks.values() for w in t.split())
            assert words == Counter(w for _, t, x in rows if x == s for w in t.split())
        assert all(set(r.doc_ids) == {int(w[1:].split("_")[0]) for w in r.text.split()} for r in mine)


def test_empty_and_wordless_tables(spark):
    assert m.taken_words(spark.createDataFrame([], SCHEMA)).collect() == []
    assert m.mixture(spark.createDataFrame([], SCHEMA)).collect() == []
    got = m.taken_words(spark.createDataFrame([(1, None, None), (2, " ", "a")], SCHEMA)).collect()
    assert {(r.doc_id, r.size, r.taken, r.target) for r in got} == {(1, 0, 0, 0.0), (2, 0, 0, 0.0)}
