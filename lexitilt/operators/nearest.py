"""The nearest words of every word: a forest of random hyperplanes, exact cosines in its leaves.

Each tree deals a model's words into buckets by the sides of random hyperplanes they lie on, as
many planes as bring the bucket down to ``leaf`` words: crowded buckets are split by further planes,
the others stay. Within a leaf all cosines are exact, and a word's nearest over all trees count. The
planes pass through the middle of a model's unit vectors, so that they part them evenly. Work and
memory are linear in the words: trees times leaf cosines a word, one leaf a task at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexitilt.functions.vector_math import norm, sum_of_vectors
from lexitilt.sources.staging import materialize

#: Hyperplanes a tree has; words that all of them leave together are as good as equal.
PLANES = 62


@dataclass(frozen=True)
class Forest:
    trees: int = 24
    leaf: int = 256
    seed: int = 11


def _codes(units: DataFrame, keys: Sequence[str], size: int, forest: Forest) -> DataFrame:
    """keys, word, tree, code: a bit for each hyperplane of the tree."""
    middles = {tuple(r[k] for k in keys): np.array(r["total"]) / r["n"] for r in units.groupBy(*keys)
               .agg(sum_of_vectors(F.col("unit"), size).alias("total"), F.count("*").alias("n"))
               .collect()}  # a vector a model
    shared = units.sparkSession.sparkContext.broadcast(middles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = [np.random.default_rng([forest.seed, t]).normal(size=(size, PLANES))
                  for t in range(forest.trees)]
        powers = np.int64(1) << np.arange(PLANES, dtype=np.int64)
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            rows = batch["unit"].flatten().to_numpy().reshape(n, size)
            middle = np.array([shared.value[m] for m in zip(*[batch[k].to_pylist() for k in keys])])
            codes = [(((rows - middle) @ p) > 0) @ powers for p in planes]
            again = pa.array(np.tile(np.arange(n), forest.trees))
            yield pa.RecordBatch.from_arrays(
                [*[batch[c].take(again) for c in (*keys, "word")],
                 pa.array(np.repeat(np.arange(forest.trees, dtype=np.int32), n)),
                 pa.array(np.concatenate(codes))], [*keys, "word", "tree", "code"])

    kinds = [f"{c} {units.schema[c].dataType.simpleString()}" for c in (*keys, "word")]
    return units.mapInArrow(run, ", ".join([*kinds, "tree int", "code long"]))


def _leaves(codes: DataFrame, keys: Sequence[str], forest: Forest) -> DataFrame:
    """keys, word, tree, depth, prefix, part: the leaf of each word in each tree.

    All buckets are split together, those still crowded by one more plane a round. Beyond the last
    plane a crowd is dealt by the words' hashes.
    """
    models = codes.where("tree = 0").groupBy(*keys).agg(F.count("*").alias("n")).select(
        *keys, F.greatest(F.ceil(F.log2(F.col("n") / forest.leaf)), F.lit(0)).cast("int").alias("depth"))
    open_ = codes.join(F.broadcast(models), list(keys))  # a row a model
    bucket = [*keys, "tree", "depth", "prefix"]
    found: DataFrame | None = None
    while True:
        ones = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("depth")) - 1
        placed = open_.withColumn("prefix", F.col("code").bitwiseAND(ones))
        sizes = placed.groupBy(*bucket).agg(F.count("*").alias("n"))
        placed = materialize(placed.join(sizes, bucket), "buckets")
        parts = F.when(F.col("n") > forest.leaf, F.pmod(
            F.xxhash64("word"), F.ceil(F.col("n") / forest.leaf))).otherwise(F.lit(0).cast("long"))
        done = placed.where((F.col("n") <= forest.leaf) | (F.col("depth") >= PLANES)).select(
            *keys, "word", "tree", "depth", "prefix", parts.alias("part"))
        found = done if found is None else found.unionByName(done)
        crowded = placed.where((F.col("n") > forest.leaf) & (F.col("depth") < PLANES))
        if crowded.isEmpty():
            return found
        open_ = crowded.select(*keys, "word", "tree", "code", (F.col("depth") + 1).alias("depth"))


def nearest_words(table: DataFrame, k: int = 10, forest: Forest = Forest(),
                  keys: Sequence[str] = ("group", "seed")) -> DataFrame:
    """keys, word, rank, neighbour, similarity: up to ``k`` words by cosine, for every word.

    ``table``: keys, word, vector (all of one size). A zero vector has no neighbours and is nobody's.
    Ties go by the neighbour's name.
    """
    keys = list(keys)
    first = table.select("vector").first()
    size = len(first["vector"]) if first else 1
    length = norm(F.col("vector"))
    units = materialize(
        table.select(*keys, "word", F.col("vector").cast("array<double>").alias("vector"))
        .withColumn("length", length).where("length > 0")
        .select(*keys, "word", F.transform("vector", lambda x: x / F.col("length")).alias("unit")),
        "units")
    leaves = _leaves(_codes(units, keys, size, forest), keys, forest)
    names = [*keys, "word", "neighbour", "similarity"]
    kinds = [f"{c} {units.schema[c].dataType.simpleString()}" for c in (*keys, "word")]

    def search(leaf: pa.Table) -> pa.Table:
        n = len(leaf)
        rows = np.array(leaf["unit"].to_pylist())
        cosines = rows @ rows.T
        np.fill_diagonal(cosines, -2)
        take = min(k, n - 1)
        near = np.argpartition(-cosines, take - 1, axis=1)[:, :take] if take > 0 \
            else np.zeros((n, 0), int)
        own, other = np.repeat(np.arange(n), near.shape[1]), near.ravel()
        return pa.table([*[leaf[c].take(pa.array(own)) for c in (*keys, "word")],
                         leaf["word"].take(pa.array(other)),
                         pa.array(np.round(cosines[own, other], 9))], names)

    found = (leaves.join(units, [*keys, "word"])
             .groupBy(*keys, "tree", "depth", "prefix", "part")
             .applyInArrow(search, ", ".join([*kinds, "neighbour string", "similarity double"])))
    pairs = found.groupBy(*keys, "word", "neighbour").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy(*keys, "word").orderBy(F.desc("similarity"), "neighbour")
    return (pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select(*keys, "word", "rank", "neighbour", "similarity"))
