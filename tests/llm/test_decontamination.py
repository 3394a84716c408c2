import random

from pyspark.sql import functions as F

from lexitilt.llm import decontamination as dc

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def least_edits(item, words):
    """Edit distance of ``item`` to the closest run of ``words``, cell by cell."""
    row = [0] * (len(words) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(words, 1):
            new.append(min(row[j - 1] + (w != v), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rng, words, edits, other):
    words = list(words)
    for _ in range(edits):
        p = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.6:
            words[p] = rng.choice(other)
        elif kind < 0.8:
            words.insert(p, rng.choice(other))
        else:
            del words[p]
    return words


def fixture(seed, share):
    rng = random.Random(seed)
    common = ["the", "of", "and", "in", "a"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(4000)}"
    items = [(k, " ".join(word() for _ in range(rng.randrange(14, 60)))) for k in range(40)]
    docs = []
    for k in range(160):
        words = [word() for _ in range(rng.randrange(80))]
        if k % 2 == 0:
            item = items[k // 2 % 40][1].split()
            passage = edited(rng, item, int(share * 0.2 * len(item)), [f"w{x}" for x in range(4000)])
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
        docs.append((k, " ".join(words).upper() if k % 3 else ", ".join(words)))
    return docs, items


def test_finds_what_brute_force_finds(spark):
    for share, recall in ((0, 1.0), (0.5, 0.98), (1.0, 0.9)):
        docs, items = fixture(int(share * 10), share)
        got = {(r.doc_id, r.item_id): r.edits for r in dc.contaminated(
            spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
        want = {}
        for d, text in docs:
            words = dc.words_of(text)
            for i, item in items:
                target = dc.words_of(item)
                if (n := least_edits(target, words)) <= int(0.2 * len(target)):
                    want[d, i] = n
        assert set(got) <= set(want) and all(got[k] >= want[k] for k in got)
        assert len(got) >= recall * len(want) >= 70


def test_odd_rows_and_blocks(spark):
    item = " ".join(f"q{k}" for k in range(20))
    items = [(1, item), (2, None), (3, ""), (4, "too short"), (None, item), (5, item + " tail")]
    docs = [(1, None), (2, ""), (3, f"before {item.upper()}! after"), (3, f"before {item}"),
            (None, item), (4, "the " * 5000), (5, "q1 q2 q3 too short"), (6, f"{item} {item}")]
    df = spark.createDataFrame(docs, DOCS).withColumns({"item_id": F.lit("x"), "edits": F.lit(0)})
    bench = spark.createDataFrame(items, ITEMS)
    for chars in (4_000_000, 70):
        got = dc.contaminated(df, bench, dc.Search(block_chars=chars)).collect()
        found = sorted((r.doc_id or 0, r.item_id or 0, r.edits) for r in got)
        assert found == sorted((d, i, e) for d in (3, 3, 0, 6) for i, e in ((1, 0), (0, 0), (5, 1)))
    kept = dc.decontaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.text) == sorted(
        x for x in docs if x[0] in (4, 5))
    assert kept.where("text is null or text = ''").count() == 2


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f")], DOCS), spark.createDataFrame([], ITEMS)
    assert dc.contaminated(docs, items).collect() == []
    assert dc.contaminated(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], ITEMS)) \
        .collect() == []
    assert dc.decontaminated(docs, items).count() == 1
