import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lexitilt.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    doc_id, source, lang, n_chars, _ = row
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}"
                     for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h("".join(last[k:k + 3])) for k in range(0, len(last), 3)])
    return levels


def proof(levels, k):
    out = []
    for nodes in levels[:-1]:
        run = k - k % 3
        out.append((nodes[run:k], nodes[k + 1:run + 3]))
        k //= 3
    return out


def brute(rows):
    """The contract, with every level in memory."""
    def tampered(row):
        hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
        return row[4].replace("\n", "") if hit and row[4] is not None else row[4]

    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for members in groups.values():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]), leaf(r, tampered(r))))
    trees = {s: tree([leaf(r, r[4]) for r in groups[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for g, s in enumerate(names):
        for k, row in enumerate(groups[s]):
            path = proof(trees[s], k) + proof(top, g)
            node = leaf(row, tampered(row))
            for left, right in path:
                node = h("".join(left) + node + "".join(right))
            out.append((row[0], leaf(row, row[4]), trees[s][-1][0], top[-1][0],
                        h("".join("".join(a + b) for a, b in path)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit("clash") for c in ("grp", "node", "pos", "path", "chunk", "tampered", "_id")})
    got = sorted((tuple(r) for r in merkle.verified_manifest(df).collect()), key=repr)
    assert got == brute(rows)
    return got


def documents(n, source):
    return [(k * 7 % n, source, "en" if k % 3 else None, k, f"line {k}\nline" if k % 2 else f"é{k}")
            for k in range(n)]


def test_many_sizes_of_groups(spark):
    rows = [row for n in (1, 2, 3, 4, 9, 10, 28, 82) for row in documents(n, f"s{n}")]
    got = check(spark, rows)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_a_group_beyond_one_stored_level(spark):
    check(spark, documents(1500, "large") + documents(1, None) + documents(3, ""))


def test_nulls_repeats_and_long_texts(spark):
    rows = [(None, None, None, None, None), (None, "a", None, None, "x\ny"), (1, "a", "en", 3, None),
            (2, "a", "en", 0, ""), (2, "a", "en", 0, ""), (2, "a", "en", 0, "other\n"),
            (-5, "a", "en", 1, "long\n" * 200_000), (10 ** 15, "ä", "zz", 1, "\n\n")]
    check(spark, rows)
    check(spark, rows[1:2])


def test_many_sources(spark):
    check(spark, [(k, f"host{k}", None, None, "t\n") for k in range(800)])


def test_empty_table(spark):
    df = merkle.verified_manifest(spark.createDataFrame([], SCHEMA))
    assert df.collect() == []
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                          "verified"]


@pytest.mark.parametrize("stride", [1, 2, 5])
def test_stride_changes_what_is_stored_and_nothing_else(spark, stride):
    rows = spark.createDataFrame(documents(100, "a") + documents(7, "b"), SCHEMA)
    leaves = rows.select(F.col("source").alias("grp"), "doc_id", F.sha2("text", 256).alias("node"))
    built = merkle.build(leaves, ["doc_id"], stride=stride)
    usual = merkle.build(leaves, ["doc_id"])
    assert built.root() == usual.root()
    assert len(built.groups) == 1 + -(-5 // stride)  # 100 leaves are five levels
    plain = lambda m: {(r.grp, r.pos): r.path for r in merkle.proofs(m).collect()}
    assert plain(built) == plain(usual)


def test_a_proof_binds_its_leaf(spark):
    rows = spark.createDataFrame(documents(30, "a") + documents(5, "b"), SCHEMA)
    leaves = rows.select(F.col("source").alias("grp"), "doc_id", F.sha2("text", 256).alias("node"))
    built = merkle.build(leaves, ["doc_id"])
    folded = merkle.proofs(built).select(
        merkle.folded(F.col("node"), F.col("path")).alias("own"),
        merkle.folded(F.sha2(F.lit("other"), 256), F.col("path")).alias("other")).collect()
    assert all(r.own == built.root() and r.other != built.root() for r in folded)
