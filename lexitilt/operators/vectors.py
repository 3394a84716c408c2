"""Word vectors per group.

Two forms of one thing. ``ppmi_vectors`` counts words in each other's company
and keeps the positive pointwise mutual information: exact, seedless, linear in
the text. ``dense_vectors`` projects those rows to a fixed number of dimensions
with seeded random signs, one set of vectors per seed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexitilt.functions import fixed_values as fv
from lexitilt.functions.vector_math import sum_of_vectors
from lexitilt.operators.corpus import min_count
from lexitilt.sources.staging import materialize, released


@dataclass(frozen=True)
class TrainingConfig:
    vector_size: int = 150
    window: int = 5
    min_n: int = 3
    max_n: int = 6


SYNTHETIC_TRAINING = TrainingConfig(vector_size=100, max_n=5)


@dataclass(frozen=True)
class WordVectors:
    """Vectors in long form.

    words: keys, word, n - the vocabulary; a word may have no cells (zero vector).
    cells: keys, word, ctx, weight - non-zero coordinates.
    """

    words: DataFrame
    cells: DataFrame
    keys: tuple[str, ...] = ("group",)

    def saved(self) -> WordVectors:
        return WordVectors(materialize(self.words, "words"),
                           materialize(self.cells, "cells"), self.keys)


def cooccurrence_counts(docs: DataFrame, words: Sequence[str] | None = None,
                        window: int = 5) -> DataFrame:
    """(group, word, ctx, n, starts, near): how often ctx stands within ``window``
    places of word, in one pass and one shuffle.

    The row with ctx NULL holds the word's own frequency ``n``, the documents it
    begins (``starts``) and its number of neighbours (``near``), which needs no
    pairs: a place has min(places before, window) + min(places after, window).
    With a word list, pairs are made for the listed words only. Neighbours are cut
    out of the document's own token array, so no join is needed, and pairs are
    counted before the shuffle.
    """
    before = F.least(F.col("pos"), F.lit(window))
    after = F.least(F.size("tokens") - 1 - F.col("pos"), F.lit(window))
    around = F.concat(F.slice("tokens", F.col("pos") - before + 1, before),
                      F.slice("tokens", F.col("pos") + 2, after))
    itself = F.array(F.lit(None).cast("string"))
    contexts = F.concat(itself, around)
    if words is not None:
        contexts = F.when(F.col("word").isin(list(words)), contexts).otherwise(itself)
    alone = F.col("ctx").isNull()
    return (
        docs.select("group", "tokens", F.posexplode("tokens").alias("pos", "word"))
        .select("group", "word", (F.col("pos") == 0).alias("start"),
                (before + after).alias("near"), F.explode(contexts).alias("ctx"))
        .groupBy("group", "word", "ctx")
        .agg(F.count("*").alias("n"),
             F.count_if(alone & F.col("start")).alias("starts"),
             F.coalesce(F.sum(F.when(alone, F.col("near"))), F.lit(0)).alias("near"))
    )


def halved_counts(docs: DataFrame, window: int = 5) -> DataFrame:
    """``cooccurrence_counts`` of all words with each pair once, the lesser word as ``word``.

    Two words are in each other's company equally often, so a place looks at the places after it
    only and half the rows cross the shuffle; ``both_ways`` gives the other half back.
    """
    before = F.least(F.col("pos"), F.lit(window))
    after = F.least(F.size("tokens") - 1 - F.col("pos"), F.lit(window))
    contexts = F.concat(F.array(F.lit(None).cast("string")), F.slice("tokens", F.col("pos") + 2, after))
    alone = F.col("ctx").isNull()
    return (
        docs.select("group", "tokens", F.posexplode("tokens").alias("pos", "word"))
        .select("group", "word", (F.col("pos") == 0).alias("start"),
                (before + after).alias("near"), F.explode(contexts).alias("ctx"))
        .select("group", "start", "near", F.least("word", "ctx").alias("word"),
                F.when(~alone, F.greatest("word", "ctx")).alias("ctx"))
        .groupBy("group", "word", "ctx")
        .agg(F.count("*").alias("n"),
             F.count_if(alone & F.col("start")).alias("starts"),
             F.coalesce(F.sum(F.when(alone, F.col("near"))), F.lit(0)).alias("near"))
    )


def both_ways(halved: DataFrame) -> DataFrame:
    """(group, word, ctx, n) of the pairs in ``halved_counts``; a word beside itself counts twice."""
    pair = F.struct("word", "ctx", "n")
    turned = F.struct(F.col("ctx").alias("word"), F.col("word").alias("ctx"), "n")
    twice = F.struct("word", "ctx", (2 * F.col("n")).alias("n"))
    return (halved.filter(F.col("ctx").isNotNull())
            .select("group", F.explode(F.when(F.col("word") == F.col("ctx"), F.array(twice))
                                       .otherwise(F.array(pair, turned))).alias("p"))
            .select("group", "p.word", "p.ctx", "p.n"))


def word_places(docs: DataFrame, window: int = 5) -> DataFrame:
    """(group, word, n, starts, near) of ``cooccurrence_counts``' rows with ctx NULL, without pairs."""
    near = F.least(F.col("pos"), F.lit(window)) + F.least(F.col("size") - 1 - F.col("pos"), F.lit(window))
    return (docs.select("group", F.size("tokens").alias("size"), F.posexplode("tokens").alias("pos", "word"))
            .groupBy("group", "word")
            .agg(F.count("*").alias("n"), F.count_if(F.col("pos") == 0).alias("starts"),
                 F.sum(near).alias("near")))


def reaching(singles: DataFrame, min_count_col: Column | None = None) -> DataFrame:
    """group, word, n, near, total: the words of ``singles`` (group, word, n, starts, near) that
    reach their group's minimum count."""
    floor = min_count(F.col("docs")) if min_count_col is None else min_count_col
    groups = (singles.groupBy("group")
              .agg(F.sum("starts").alias("docs"), F.sum("near").alias("total"),
                   F.count("*").alias("vocab_size"))
              .select("group", F.col("total").cast("double").alias("total"),
                      floor.alias("floor")))
    return (singles.join(F.broadcast(groups), "group").filter(F.col("n") >= F.col("floor"))
            .select("group", "word", "n", F.col("near").cast("double").alias("near"), "total"))


def associated_pairs(docs: DataFrame, words: Sequence[str] | None = None, *, window: int = 5,
                     min_count_col: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, pairs): the words and the pairs of words that reach the group's minimum count.

    vocabulary: group, word, n, near, total - all words, whatever ``words``; pairs: group, word,
    ctx, n, near, ctx_near, total with word in ``words``. ``near`` counts the places around a
    word, ``total`` those around all words of the group. Contexts are joined first, so that the
    pairs lie by word where sums over a word's contexts follow.
    """
    counts = (released(materialize(halved_counts(docs, window), "pairs")) if words is None
              else materialize(cooccurrence_counts(docs, words, window), "pairs"))
    vocabulary = reaching(counts.filter(F.col("ctx").isNull()), min_count_col)
    of_word = _listed(vocabulary, words).select("group", "word", "near", "total")
    of_ctx = vocabulary.select("group", F.col("word").alias("ctx"),
                               F.col("near").alias("ctx_near"))
    seen = both_ways(counts) if words is None else counts.filter(F.col("ctx").isNotNull())
    pairs = (seen.select("group", "word", "ctx", F.col("n").cast("double").alias("n"))
             .join(of_ctx, ["group", "ctx"])
             .join(of_word, ["group", "word"]))
    return vocabulary, pairs


def _listed(vocabulary: DataFrame, words: Sequence[str] | None) -> DataFrame:
    return vocabulary if words is None else vocabulary.filter(F.col("word").isin(list(words)))


def mutual_information(shift: float = 1.0) -> Column:
    """Of a row of ``associated_pairs``: ln(n(w,c) * N / (n(w) * n(c) * shift))."""
    return F.ln((F.col("n") * F.col("total")) / (F.col("near") * F.col("ctx_near") * F.lit(shift)))


def ppmi_vectors(docs: DataFrame, words: Sequence[str] | None = None, *, window: int = 5,
                 shift: float = 1.0, min_count_col: Column | None = None) -> WordVectors:
    """Positive pointwise mutual information of words and their neighbours.

    weight = ln(n(w,c) * N / (n(w) * n(c) * shift)) where positive, over the
    words and contexts that reach the group's minimum count. ``words`` limits the
    rows that are built, not the statistics.
    """
    vocabulary, pairs = associated_pairs(docs, words, window=window, min_count_col=min_count_col)
    cells = (pairs.withColumn("weight", mutual_information(shift))
             .filter(F.col("weight") > 0)
             .select("group", "word", "ctx", "weight"))
    return WordVectors(_listed(vocabulary, words).select("group", "word", "n"), cells)


SIGN_BITS = 60  # bits taken from one md5, as fifteen hexadecimal digits


def sign_bits(seed: Column, ctx: Column, block: int) -> Column:
    digest = F.md5(F.concat_ws(":", seed.cast("string"), F.lit(str(block)), ctx))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def dense_vectors(vectors: WordVectors, seeds: Sequence[int] = tuple(fv.SEEDS),
                  vector_size: int = TrainingConfig.vector_size) -> DataFrame:
    """(group, seed, word, n, vector): random-sign projection of sparse rows.

    Coordinate j is the sum of the row's weights, each with the sign that
    (seed, ctx, j) hashes to, over sqrt(vector_size). Inner products are kept in
    expectation (Achlioptas, 2003). Nothing is shared between tasks, and the
    sums are built before the shuffle, so the shuffle holds one row per word.
    """
    blocks = math.ceil(vector_size / SIGN_BITS)
    seed_list = F.array(*[F.lit(s) for s in seeds])
    signed = (vectors.cells
              .select("group", "word", "ctx", "weight", F.explode(seed_list).alias("seed"))
              .select("group", "seed", "word", "weight", *[
                  sign_bits(F.col("seed"), F.col("ctx"), b).alias(f"h{b}") for b in range(blocks)]))
    scale = 1.0 / math.sqrt(vector_size)

    def coordinate(j: int) -> Column:
        bit = F.shiftrightunsigned(F.col(f"h{j // SIGN_BITS}"), j % SIGN_BITS).bitwiseAND(1)
        return F.sum(F.when(bit == 1, F.col("weight")).otherwise(-F.col("weight"))) * scale

    sums = signed.groupBy("group", "seed", "word").agg(
        *[coordinate(j).alias(f"v{j}") for j in range(vector_size)])
    rows = sums.select("group", "seed", "word",
                       F.array(*[f"v{j}" for j in range(vector_size)]).alias("vector"))
    zero = F.array_repeat(F.lit(0.0), vector_size)
    return (vectors.words.select("group", "word", "n", F.explode(seed_list).alias("seed"))
            .join(rows, ["group", "seed", "word"], "left")
            .select("group", "seed", "word", "n", F.coalesce("vector", zero).alias("vector")))


def from_dense(table: DataFrame, keys: Sequence[str] = ("group", "seed")) -> WordVectors:
    """Long form of a dense vector table (keys, word, vector)."""
    n = F.col("n") if "n" in table.columns else F.lit(1).cast("bigint").alias("n")
    cells = (table.select(*keys, "word", F.posexplode("vector").alias("ctx", "weight"))
             .withColumn("weight", F.col("weight").cast("double")))
    return WordVectors(table.select(*keys, "word", n), cells.filter(F.col("weight") != 0),
                       tuple(keys))


# Subwords

def subwords(word: Column, min_n: int = 3, max_n: int = 6) -> Column:
    """Distinct character n-grams of the word between boundary marks."""
    marked = F.concat(F.lit("<"), word, F.lit(">"))
    grams = F.flatten(F.transform(
        F.sequence(F.lit(min_n), F.lit(max_n)),
        lambda n: F.transform(
            F.filter(F.sequence(F.lit(1), F.greatest(F.length(marked), F.lit(1))),
                     lambda i: i + n - 1 <= F.length(marked)),
            lambda i: F.substring(marked, i, n))))
    return F.array_distinct(grams)


def subword_counts(words: DataFrame, min_n: int = 3, max_n: int = 6) -> DataFrame:
    """(group, gram, words, n): in how many vocabulary words and tokens a gram occurs."""
    return (words.select("group", "n", F.explode(subwords(F.col("word"), min_n, max_n))
                         .alias("gram"))
            .groupBy("group", "gram")
            .agg(F.count("*").alias("words"), F.sum("n").alias("n")))


def compose_subwords(table: DataFrame, targets: Sequence[str] | None = None, *,
                     vector_size: int = TrainingConfig.vector_size,
                     min_n: int = 3, max_n: int = 6) -> DataFrame:
    """Smooth a saved table of dense vectors by their subwords.

    A gram's vector is the mean of the vectors of the words that hold it, weighted
    by frequency; a word's new vector is the mean of its own and its grams'.
    With ``targets`` only those words are built, and only their grams are summed.
    Coverage does not change: words outside the vocabulary get no vector. A table cut into slices
    (see ``slices``) has its own links, and all its words are built.
    """
    if not isinstance(table, DataFrame):
        return table.then("means")
    keys = ["group", "seed"]
    if targets is None:
        wanted = table
        totals = (table.select(*keys, "word", "n", "vector",
                               F.explode(subwords(F.col("word"), min_n, max_n)).alias("gram"))
                  .groupBy(*keys, "gram")
                  .agg(sum_of_vectors(F.col("vector"), vector_size, F.col("n")).alias("total"),
                       F.sum("n").alias("n")))
    else:
        sums = materialize(_sums_of_grams(table, targets, vector_size, min_n, max_n), "grams")
        wanted = sums.filter(F.col("gram").isNull()).select(*keys, "word", "vector")
        totals = (sums.filter(F.col("gram").isNotNull()).groupBy(*keys, "gram")
                  .agg(sum_of_vectors(F.col("vector"), vector_size).alias("total"), F.sum("n").alias("n")))
    links = wanted.select(*keys, "word", F.explode(
        subwords(F.col("word"), min_n, max_n)).alias("gram"))
    gram_vectors = totals.select(*keys, "gram", F.transform("total", lambda x: x / F.col("n")).alias("vector"))
    parts = (links.join(gram_vectors, [*keys, "gram"]).select(*keys, "word", "vector")
             .unionByName(wanted.select(*keys, "word", "vector")))
    return (parts.groupBy(*keys, "word")
            .agg(sum_of_vectors(F.col("vector"), vector_size).alias("total"),
                 F.count("*").alias("parts"))
            .select(*keys, "word",
                    F.transform("total", lambda x: x / F.col("parts")).alias("vector")))


#: Bytes of gram sums that a task holds.
_SUM_BYTES = 1 << 27


def _sums_of_grams(table: DataFrame, targets: Sequence[str], vector_size: int, min_n: int, max_n: int) -> DataFrame:
    """In one reading of ``table``: the rows of the listed words (gram NULL), and of each of their grams
    the vectors of the words that hold it, summed by frequency, and their frequency (word NULL), a row a
    task. So no vector goes with each of its word's grams."""
    spark = table.sparkSession
    listed = spark.createDataFrame([(w,) for w in sorted(set(targets))], "word string")
    names = sorted({r["gram"] for r in listed.select(
        F.explode(subwords(F.col("word"), min_n, max_n)).alias("gram")).collect()})  # of the given words
    number, wanted = {g: i for i, g in enumerate(names)}, set(targets)
    columns = ["group", "seed", "word", "gram", "n", "vector"]

    def rows(key: tuple, words: list, grams: list, n: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(0, vectors.size + 1, vector_size, dtype=np.int32)), pa.array(vectors.ravel()))
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * len(n), pa.string()), pa.array([key[1]] * len(n), pa.int32()),
             pa.array(words, pa.string()), pa.array(grams, pa.string()), pa.array(n, pa.int64()), lists], columns)

    def result(key: tuple, total: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        seen = np.flatnonzero(n)
        if len(seen):
            yield rows(key, [None] * len(seen), [names[g] for g in seen], n[seen], total[seen])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            vectors = batch["vector"].flatten().to_numpy().reshape(-1, vector_size)
            keys = zip(batch["group"].to_pylist(), batch["seed"].to_pylist())
            for k, (key, word, n) in enumerate(zip(keys, batch["word"].to_pylist(), batch["n"].to_pylist())):
                marked = f"<{word}>"
                own = list({g for size in range(min_n, max_n + 1) for i in range(len(marked) - size + 1)
                            if (g := number.get(marked[i:i + size])) is not None})
                if own:
                    if key not in held:
                        if (len(held) + 1) * len(names) * vector_size * 8 > _SUM_BYTES:
                            for other in list(held):
                                yield from result(other, *held.pop(other))
                        held[key] = np.zeros((len(names), vector_size)), np.zeros(len(names), np.int64)
                    held[key][0][own] += n * vectors[k]
                    held[key][1][own] += n
                if word in wanted:
                    yield rows(key, [word], [None], np.array([n]), vectors[k:k + 1])
        for key, sums in held.items():
            yield from result(key, *sums)

    table = table.filter(F.col("word").isNotNull()).select(
        "group", "seed", "word", F.col("n").cast("long").alias("n"), F.col("vector").cast("array<double>").alias("vector"))
    return table.mapInArrow(run, "group string, seed int, word string, gram string, n long, vector array<double>")


# Neighbours

def neighbours(vectors: WordVectors, queries: Sequence[str] = tuple(fv.NEIGHBOUR_WORDS),
               k: int = 10) -> DataFrame:
    """The k words nearest to each query word by cosine, in every model.

    Each coordinate meets the queries' weights at it, side by side in one row, so
    the cells are joined once and summed once for all queries together.
    """
    keys = list(vectors.keys)
    columns = {q: f"q{i}" for i, q in enumerate(queries)}
    at_ctx = (vectors.cells.filter(F.col("word").isin(list(queries)))
              .groupBy(*keys, "ctx")
              .agg(*[F.sum(F.when(F.col("word") == q, F.col("weight"))).alias(c)
                     for q, c in columns.items()]))
    per_word = (vectors.cells.join(at_ctx, [*keys, "ctx"], "left")
                .groupBy(*keys, "word")
                .agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"),
                     *[F.sum(F.col("weight") * F.col(c)).alias(c) for c in columns.values()]))
    norms = (per_word.filter(F.col("word").isin(list(queries)))
             .select(*keys, F.col("word").alias("query"), F.col("norm").alias("query_norm")))
    pairs = F.explode(F.array(*[
        F.struct(F.lit(q).alias("query"), F.col(c).alias("dot")) for q, c in columns.items()]))
    # A query's own norm does not change its ranking, so it joins the few rows left.
    order = W.partitionBy(*keys, "query").orderBy(F.desc("score"), "word")
    return (per_word.select(*keys, "word", "norm", pairs.alias("p"))
            .filter(F.col("word") != F.col("p.query"))
            .select(*keys, "p.query", "word", F.round(
                F.coalesce("p.dot", F.lit(0.0)) / F.col("norm"), 9).alias("score"))
            .withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k)
            .join(norms, [*keys, "query"])
            .select(*keys, "query", "rank", "word",
                    (F.col("score") / F.col("query_norm")).alias("similarity")))
