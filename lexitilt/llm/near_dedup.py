"""Near duplicates by SimHash, found with an inverted index on positional bytes.

A 64-bit fingerprint has eight bytes. Two fingerprints that differ in at most four bits
agree in at least four of the eight byte positions, so a pair is a candidate when its tally
of shared positional bytes reaches four; the exact bit count then decides.

A posting list of one byte position would hold 1/256 of all fingerprints, and its pairs
would grow with the square of the table. The index is therefore keyed by four positions at
a time, the guaranteed minimum (70 keys a fingerprint): a list then holds only fingerprints
whose tally has reached it. Lists are of distinct fingerprints; copies never meet in one.

A list of two is a pair. A longer list is worked through in one place and leaves at most one
link a member (a spanning forest). A list over ``MAX_LIST`` is not gathered at all: each of
its members is sent to all values within two bits of it, and two fingerprints within four
bits always share such a value. That is exact, and its rows grow with the list, not its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitilt.llm.common import durable

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
MAX_LIST = 2048
_BATCH_SHINGLES = 400_000


def shingle_hashes(text: str | None, width: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of each run of ``width`` words, repeats included; of all words if fewer.

    Bytes are lower-cased in A-Z alone and split at space and tab to carriage return,
    which is what ``bytes.lower`` and ``bytes.split`` do.
    """
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-width])).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1:] - 1).tolist())]


def majority_bits(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One 64-bit value for each run of ``hashes``: the bits set in over half the run.

    Bits k and k + 32 of all hashes are counted at once, in the halves of one 64-bit sum.
    """
    lanes, out = np.uint64(0x0000000100000001), np.zeros(len(starts), np.uint64)
    n = np.diff(np.append(starts, len(hashes))).astype(np.uint64)
    for k in range(32):
        both = np.add.reduceat((hashes >> np.uint64(k)) & lanes, starts)
        low, high = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
        out |= (2 * low > n).astype(np.uint64) << np.uint64(k)
        out |= (2 * high > n).astype(np.uint64) << np.uint64(k + 32)
    return out


def fingerprint_texts(texts: list[str | None], width: int = SHINGLE_WORDS) -> np.ndarray:
    """The fingerprints of ``texts`` as unsigned 64-bit values; zero for a text without words."""
    out = np.zeros(len(texts), np.uint64)
    held: list[np.ndarray] = []
    rows: list[int] = []

    def settle() -> None:
        if rows:
            sizes = [len(h) for h in held]
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
            out[rows] = majority_bits(np.concatenate(held), starts)
            held.clear()
            rows.clear()

    size = 0
    for k, text in enumerate(texts):
        if hashes := shingle_hashes(text, width):
            held.append(np.array(hashes, np.uint64))
            rows.append(k)
            size += len(hashes)
            if size > _BATCH_SHINGLES:
                settle()
                size = 0
    settle()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, the fingerprint as a signed 64-bit value, and mark, a hash of the whole text;
    one row a document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = fingerprint_texts(batch["text"].tolist()).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": found, "mark": batch["mark"]})

    narrow = docs.select(F.col(id_col).cast("string").alias("doc_id"),
                         F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("mark"))
    kind = docs.schema[id_col].dataType
    # ids go through Python as text, so that a null id stays null and no id is rounded
    return narrow.mapInPandas(run, "doc_id string, fp long, mark long").select(
        F.col("doc_id").cast(kind).alias("doc_id"), "fp", "mark")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def position_masks() -> list[int]:
    """A mask for each choice of four of the eight byte positions."""
    return [_signed(sum(0xFF << (8 * p) for p in chosen))
            for chosen in combinations(range(8), 8 - MAX_BITS)]


def ball_masks(radius: int = MAX_BITS // 2) -> list[int]:
    """All 64-bit masks of at most ``radius`` bits."""
    return [_signed(sum(1 << b for b in bits))
            for r in range(radius + 1) for bits in combinations(range(64), r)]


def _index(fps: DataFrame) -> DataFrame:
    keys = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m)))
            for k, m in enumerate(position_masks())]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _near(a: Column, b: Column) -> Column:
    shared = sum((a.bitwiseAND(F.lit(_signed(0xFF << (8 * p))))
                  == b.bitwiseAND(F.lit(_signed(0xFF << (8 * p))))).cast("int")
                 for p in range(8))
    return (shared >= 8 - MAX_BITS) & (F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS)


def spanning_forest(values: np.ndarray) -> list[tuple[int, int]]:
    """(smallest member of its cluster, member) for each value that links to another."""
    values = np.sort(values)
    bits = values.view(np.uint64)
    label = np.arange(len(values))
    step = max(1, 4_000_000 // len(values))
    linked = [np.bitwise_count(bits[k:k + step, None] ^ bits[None, :]) <= MAX_BITS
              for k in range(0, len(values), step)]
    while True:
        least = np.concatenate([np.where(m, label[None, :], len(values)).min(axis=1)
                                for m in linked])
        least = least[least]
        if (least == label).all():
            break
        label = least
    return [(int(values[r]), int(v)) for r, v in zip(label, values) if values[r] != v]


def links(fps: DataFrame, max_list: int = MAX_LIST) -> DataFrame:
    """Links a, b between distinct fingerprints that give the same components as all links
    of at most four differing bits. ``fps``: one column fp, no value twice."""
    index = _index(fps)
    lists = index.groupBy("key").agg(
        F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")) \
        .where(F.col("n") >= 2)
    lists = durable(lists)
    pairs = lists.where((F.col("n") == 2) & _near(F.col("a"), F.col("b"))).select("a", "b")
    longer = index.join(lists.where(F.col("n") > 2).select("key", "n"), "key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {e for fps in batch["fps"] for e in spanning_forest(np.asarray(fps, np.int64))}
            yield pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    gathered = (longer.where(F.col("n") <= max_list).groupBy("key")
                .agg(F.collect_list("fp").alias("fps")).select("fps")
                .mapInPandas(run, "a long, b long"))
    crowded = longer.where(F.col("n") > max_list).select("fp").distinct()
    around = crowded.select("fp", F.explode(F.transform(
        F.array(*[F.lit(m) for m in ball_masks()]),
        lambda m: F.col("fp").bitwiseXOR(m))).alias("value"))
    centre = around.groupBy("value").agg(F.min("fp").alias("a"), F.max("fp").alias("last")) \
        .where(F.col("a") < F.col("last")).select("value", "a")
    spread = around.join(centre, "value").where(F.col("a") < F.col("fp")) \
        .select("a", F.col("fp").alias("b"))
    return pairs.unionByName(gathered).unionByName(spread).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node that ``edges`` (a, b) lead to; linked nodes only.

    Alternating large-star and small-star steps (Kiveris et al., 2014): the number of
    rounds grows with the logarithm of the longest chain. Each round is written out.
    """
    edges = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .where("u <> v").distinct())
    mark = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
                        .alias("s")).first()
        if now == mark or not now["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")) \
            .select("u", F.least("u", "w").alias("w"))
        large = both.where("v > u").join(least, "u") \
            .select(F.col("v").alias("u"), F.col("w").alias("v")).distinct()
        first = large.groupBy("u").agg(F.min("v").alias("w"))
        small = large.join(first, "u").where("v <> w") \
            .select(F.col("v").alias("u"), F.col("w").alias("v"))
        edges = durable(small.unionByName(first.select("u", F.col("w").alias("v"))).distinct())


def grouped(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
            max_list: int = MAX_LIST) -> DataFrame:
    """doc_id, fp, mark (see ``fingerprints``), root (a fingerprint that stands for the component)
    and component_id; one row a document."""
    marked = durable(fingerprints(docs, id_col, text))
    least = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    rooted = components(links(least.select("fp"), max_list))
    by_fp = least.join(rooted.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    by_root = by_fp.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = by_fp.join(by_root, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                    max_list: int = MAX_LIST) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id; one row a document.

    component_id is the smallest id reachable over links, the document's own included.
    A null or empty text has fingerprint zero, which links like any other. A null id keeps
    its row and takes part, but is no component's id while another id is there. Repeated
    rows give repeated results; an empty table gives no rows; other columns are not used.
    """
    return grouped(docs, id_col, text, max_list).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                  max_list: int = MAX_LIST) -> DataFrame:
    """``docs`` with one document of each component of ``near_duplicates``: the smallest id's.

    Where several texts of a group have that id, the one with the least hash stays, and of equal
    rows one; texts of one id that are in different groups all count.
    Rows without an id cannot be named as a copy of another, and stay. An empty table stays
    empty, texts of any length are fingerprinted whole, and other columns are kept as they are.
    """
    named = docs.where(F.col(id_col).isNotNull())
    first = grouped(named, id_col, text, max_list).where("doc_id = component_id") \
        .groupBy("root", "doc_id").agg(F.min("mark").alias("mark"))
    rows = named.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"),
                        F.xxhash64(F.col(text)).alias("mark"))
    kept = rows.join(first, ["doc_id", "mark"], "left_semi").dropDuplicates(["doc_id", "mark"])
    return kept.select("row.*").unionByName(docs.where(F.col(id_col).isNull()))
