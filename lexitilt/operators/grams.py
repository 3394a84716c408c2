"""Vectors of character n-grams as unknowns: every word the mean of its grams, solved by ridge.

Grams are hashed into ``buckets``. With M the words' shares in buckets and X the words' vectors, the
gram vectors Z make |X - M Z|^2 + ridge |Z|^2 least. Conjugate gradients solve all models (group and
seed) and all coordinates side by side: a step needs M'M P once. M P is worked out in blocks of
words, each of which meets the vectors of its own buckets once, and M' of that in the same place, so
a step is one exchange of bucket vectors to blocks and one of partial sums back. Everything else is
arithmetic on columns; the driver sees four numbers a coordinate and model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitilt.functions.vector_math import sum_of_vectors
from lexitilt.operators import slices
from lexitilt.operators.company import by_unit
from lexitilt.operators.vectors import TrainingConfig, subwords
from lexitilt.sources.staging import emptied, materialize

_MODEL = ["group", "seed"]


@dataclass(frozen=True)
class Ridge:
    vector_size: int = TrainingConfig.vector_size
    min_n: int = TrainingConfig.min_n
    max_n: int = TrainingConfig.max_n
    buckets: int = 1 << 21
    ridge: float = 0.002
    steps: int = 12
    block_words: int = 1024


@dataclass(frozen=True)
class GramVectors:
    """vectors: group, seed, bucket, vector; links: group, block, bucket, ids, shares;
    residuals: group, seed, step, residual (the gradient's length, as a share of the first)."""

    vectors: DataFrame
    links: DataFrame
    residuals: DataFrame
    config: Ridge


def gram_links(words: DataFrame, config: Ridge) -> DataFrame:
    """group, block, bucket, ids, shares: of a block of words, those with grams in the bucket and
    which share of their grams they have there. ``words``: group, word, no row twice."""
    blocks = words.groupBy("group").agg(F.ceil(F.count("*") / config.block_words).alias("blocks"))
    grams = subwords(F.col("word"), config.min_n, config.max_n)
    own = F.when(F.size(grams) > 0, grams).otherwise(F.array(F.concat(F.lit("<"), "word", F.lit(">"))))
    shares = (words.join(F.broadcast(blocks), "group")  # a row a group
              .select("group", F.xxhash64("word").alias("id"), "blocks", own.alias("grams"))
              .select("group", "id", F.pmod("id", "blocks").alias("block"),
                      (1 / F.size("grams")).alias("share"), F.explode("grams").alias("gram"))
              .groupBy("group", "block", F.pmod(F.xxhash64("gram"), F.lit(config.buckets)).alias("bucket"), "id")
              .agg(F.sum("share").alias("share")))
    return shares.groupBy("group", "block", "bucket").agg(
        F.collect_list("id").alias("ids"), F.collect_list("share").alias("shares"))


def _in_blocks(links: DataFrame, size: int, *, buckets: DataFrame | None = None,
               words: DataFrame | None = None, to_words: bool = False) -> DataFrame:
    """M' Q by bucket (partial sums: group, seed, bucket, vector), or Q by word (group, seed, id,
    vector), where Q is M times the vectors of ``buckets`` or the vectors of ``words``."""
    name, from_words = "id" if to_words else "bucket", buckets is None

    def in_rows(column: pa.ChunkedArray) -> np.ndarray:
        return pc.list_flatten(column).to_numpy().reshape(-1, size)

    def result(key: tuple, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a block: its links as three columns side by side, summed by word and by bucket."""
        whole = pa.Table.from_batches(parts)
        linked = whole.filter(pc.is_valid(whole["ids"]))
        if not len(linked):
            return
        sizes = pc.list_value_length(linked["ids"]).to_numpy()
        ids, at = np.unique(pc.list_flatten(linked["ids"]).to_numpy(), return_inverse=True)
        weights = pc.list_flatten(linked["shares"]).to_numpy()[:, None]
        if not from_words:
            order = np.argsort(at, kind="stable")
            met = in_rows(linked["vector"])[np.repeat(np.arange(len(sizes)), sizes)[order]]
            rows = np.add.reduceat(met * weights[order], np.searchsorted(at[order], np.arange(len(ids))), axis=0)
        else:
            known = whole.filter(pc.is_null(whole["ids"]))  # a word and its vector
            known = known.filter(pc.is_in(known["number"], pa.array(ids)))
            rows = np.zeros((len(ids), size))
            rows[np.searchsorted(ids, known["number"].to_numpy())] = in_rows(known["vector"])
        if to_words:
            names, out = ids, rows
        else:
            names = linked["number"].to_numpy()
            out = np.add.reduceat(rows[at] * weights, np.cumsum(sizes) - sizes, axis=0)
        n = len(names)
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(0, n * size + 1, size, dtype=np.int32)), pa.array(out.ravel()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * n), pa.array([key[1]] * n, pa.int32()), pa.array(names), lists],
            ["group", "seed", name, "vector"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for at, part in by_unit(batches, ("group", "seed", "block")):
            if at != key and held:
                yield from result(key, held)
                held = []
            key = at
            held.append(part)
        if held:
            yield from result(key, held)

    columns = ["group", "seed", "block", "kind", "number", "vector", "ids", "shares"]
    kind = F.lit(1).alias("kind")
    if buckets is not None:
        rows = links.join(buckets, ["group", "bucket"]).select(
            "group", "seed", "block", kind, F.col("bucket").alias("number"), "vector", "ids", "shares")
    else:
        models = words.select(*_MODEL).distinct()
        no = F.lit(None).cast("array<double>").alias("vector")
        rows = links.join(F.broadcast(models), "group").select(
            "group", "seed", "block", kind, F.col("bucket").alias("number"), no, "ids", "shares")
        rows = rows.unionByName(words.select(
            "group", "seed", "block", F.lit(0).alias("kind"), F.col("id").alias("number"), "vector",
            F.lit(None).cast("array<long>").alias("ids"),
            F.lit(None).cast("array<double>").alias("shares")))
    tasks = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*columns).repartition(tasks, "group", "seed", "block") \
        .sortWithinPartitions("group", "seed", "block", "kind") \
        .mapInArrow(run, f"group string, seed int, {name} long, vector array<double>")


def _plus(a: Column, b: Column, factor: Column | None = None) -> Column:
    """a + factor * b by coordinate."""
    if factor is None:
        return F.zip_with(a, b, lambda x, y: x + y)
    return F.zip_with(a, F.zip_with(b, factor, lambda y, f: y * f), lambda x, y: x + y)


def _times(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def fit(table: DataFrame | slices.Cut, config: Ridge = Ridge()) -> GramVectors | slices.Cut:
    """Gram vectors of every model in ``table`` (group, seed, word, vector), whole vocabularies.

    Each step's state is written, so a lost executor costs a part of a step; of a table cut into
    slices, a slice takes all steps in its task.
    """
    if isinstance(table, slices.Cut):
        return replace(table, config=config).then("solved")
    size = config.vector_size
    spark = table.sparkSession
    table = table.select(*_MODEL, "word", F.col("vector").cast("array<double>").alias("vector"))
    vocabulary = table.select("group", "word").distinct()
    links = materialize(gram_links(vocabulary, config), "links")
    places = links.select("group", "block", F.explode("ids").alias("id")).distinct()
    words = table.withColumn("id", F.xxhash64("word")).join(places, ["group", "id"])
    start = _in_blocks(links, size, words=words)
    sums = lambda df: df.groupBy(*_MODEL, "bucket").agg(
        sum_of_vectors(F.col("vector"), size).alias("vector"))
    zero = F.array_repeat(F.lit(0.0), size)
    state = materialize(sums(start).select(
        *_MODEL, "bucket", zero.alias("z"), F.col("vector").alias("r"), F.col("vector").alias("p")),
        "state")
    residuals, first, before = [], {}, state
    for step in range(config.steps):
        moved = sums(_in_blocks(links, size, buckets=state.select(
            *_MODEL, "bucket", F.col("p").alias("vector"))))
        joined = materialize(
            state.join(moved, [*_MODEL, "bucket"])
            .withColumn("s", _plus(F.col("vector"), F.transform("p", lambda x: x * config.ridge)))
            .drop("vector"), "state")
        products = joined.groupBy(*_MODEL).agg(*[
            sum_of_vectors(_times(a, b), size).alias(a + b) for a, b in ("rr", "ps", "rs", "ss")]).collect()
        factors = []
        for m in products:
            rr, ps, rs, ss = (np.array(m[c]) for c in ("rr", "ps", "rs", "ss"))
            alpha = np.divide(rr, ps, out=np.zeros(size), where=ps > 0)
            left = np.maximum(rr - 2 * alpha * rs + alpha ** 2 * ss, 0)
            beta = np.divide(left, rr, out=np.zeros(size), where=rr > 0)
            key = m["group"], m["seed"]
            first.setdefault(key, float(np.sqrt(rr.sum())) or 1.0)
            residuals.append((*key, step, float(np.sqrt(left.sum())) / first[key]))
            factors.append((*key, alpha.tolist(), (-alpha).tolist(), beta.tolist()))
        if not factors:
            break
        emptied(before)  # the step before, now that this one is written
        before = joined
        scalars = spark.createDataFrame(factors, "group string, seed int, a array<double>, "
                                                 "minus array<double>, b array<double>")
        state = (joined.join(F.broadcast(scalars), _MODEL)  # a row a model
                 .withColumn("z", _plus(F.col("z"), F.col("p"), F.col("a")))
                 .withColumn("r", _plus(F.col("r"), F.col("s"), F.col("minus")))
                 .withColumn("p", _plus(F.col("r"), F.col("p"), F.col("b")))
                 .select(*_MODEL, "bucket", "z", "r", "p"))
    vectors = state.select(*_MODEL, "bucket", F.col("z").alias("vector"))
    return GramVectors(vectors, links, spark.createDataFrame(
        residuals, "group string, seed int, step int, residual double"), config)


def composed(grams: GramVectors | slices.Cut, words: DataFrame | slices.Cut) -> DataFrame | slices.Cut:
    """group, seed, word, vector: the words of the vocabulary as the means of their grams.

    ``words``: group, word. Words outside the vocabulary that the grams were fitted to get none.
    """
    if isinstance(grams, slices.Cut):
        return grams.then("composed")
    made = _in_blocks(grams.links, grams.config.vector_size, buckets=grams.vectors, to_words=True)
    named = words.select("group", "word").distinct().withColumn("id", F.xxhash64("word"))
    return made.join(named, ["group", "id"]).select(*_MODEL, "word", "vector")


def reconstruction(made: DataFrame | slices.Cut, table: DataFrame | slices.Cut) -> DataFrame:
    """group, seed, words, error: how far ``made`` is from ``table`` (both group, seed, word,
    vector), as a share of the table's squared length."""
    if isinstance(made, slices.Cut):
        return slices.reconstruction(made)
    own = made.select(*_MODEL, "word", F.col("vector").alias("made"))
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda total, x: total + x * x)
    gap = F.zip_with("made", "vector", lambda x, y: x - y)
    return table.join(own, [*_MODEL, "word"]).groupBy(*_MODEL).agg(
        F.count("*").alias("words"),
        (F.sum(square(gap)) / F.sum(square(F.col("vector")))).alias("error"))
