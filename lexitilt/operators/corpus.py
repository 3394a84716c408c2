"""Corpus statistics over token arrays: ``tokens`` is an array column per document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexitilt.functions import fixed_values as fv
from lexitilt.operators.shaping import in_group_order


def with_tokens(df: DataFrame, tokens: Column, group: Column, **carry: Column) -> DataFrame:
    """(group, tokens) per document; documents without a group are left out."""
    named = [c.alias(n) for n, c in carry.items()]
    return (df.select(group.alias("group"), *named, tokens.alias("tokens"))
            .filter(F.col("group").isNotNull()))


def min_count(documents: Column, steps=tuple(fv.MIN_COUNT_STEPS)) -> Column:
    """Minimum word count that suits a corpus of this many documents."""
    (limit, value), *rest = steps
    case = F.when(documents < limit, value)
    for limit, value in rest:
        case = case.when(documents < limit, value)
    return case.otherwise(fv.MIN_COUNT_ABOVE)


def min_count_synthetic(documents: Column, vocabulary: Column) -> Column:
    """Other steps, and one lower (at least 1) for a small vocabulary."""
    base = min_count(documents, fv.MIN_COUNT_STEPS_SYNTHETIC)
    return F.when(vocabulary < fv.SMALL_VOCABULARY, F.greatest(base - 1, F.lit(1))).otherwise(base)


def word_counts(docs: DataFrame) -> DataFrame:
    """(group, word, n, is_word), with two marker rows per group that count its
    documents: word NULL those with tokens, word '' those without.

    The markers ride in the same pass, and counting before the shuffle leaves one
    row per word and task, however common the word. ``is_word`` is an aggregate, so
    filters on it stay above the shuffle and several readers of the counts share it.
    """
    marker = F.when(F.size("tokens") == 0, "")
    is_word = F.col("word").isNotNull() & (F.col("word") != "")
    return (docs.select("group", F.explode(F.concat(F.array(marker), F.col("tokens")))
                        .alias("word"))
            .groupBy("group", "word")
            .agg(F.count("*").alias("n"), F.bool_or(is_word).alias("is_word")))


def words_only(counts: DataFrame) -> DataFrame:
    return counts.filter(F.col("is_word")).drop("is_word")


def stats_from_counts(counts: DataFrame) -> DataFrame:
    marker = ~F.col("is_word")

    def total(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))

    return (counts.groupBy("group").agg(
        total(marker).alias("documents"),
        total(marker & F.col("word").isNull()).alias("docs"),
        total(F.col("is_word")).alias("tokens"),
        F.count_if("is_word").alias("vocab_size"))
        .withColumn("avg_doc_len", F.coalesce(F.try_divide(
            F.col("tokens").cast("double"), F.col("docs")), F.lit(0.0))))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """Documents with tokens, tokens, mean length and vocabulary size per group."""
    return stats_from_counts(word_counts(docs)).drop("documents")


def with_min_counts(stats: DataFrame) -> DataFrame:
    return stats.withColumns({
        "min_count": min_count(F.col("docs")),
        "min_count_synthetic": min_count_synthetic(F.col("docs"), F.col("vocab_size"))})


def vocabulary(docs: DataFrame, *, synthetic: bool = False) -> DataFrame:
    """(group, word, n) of words that reach their group's minimum count."""
    counts = word_counts(docs)
    floor = "min_count_synthetic" if synthetic else "min_count"
    floors = with_min_counts(stats_from_counts(counts)).select(
        "group", F.col(floor).alias("_floor"))
    return (words_only(counts)
            .join(F.broadcast(floors), "group")  # one row a group
            .filter(F.col("n") >= F.col("_floor")).drop("_floor"))


def top_words(docs: DataFrame, k: int = 15) -> DataFrame:
    """The k most frequent words of each group; ties by word."""
    order = W.partitionBy("group").orderBy(F.desc("n"), "word")
    return (words_only(word_counts(docs))
            .withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k))


def group_profile(docs: DataFrame, group: str, k: int = 30) -> DataFrame:
    """The k most frequent words of one group, each with the group's distinct words."""
    counts = words_only(word_counts(docs.filter(F.col("group") == group)))
    distinct = counts.agg(F.count("*").alias("distinct_words"))
    top = counts.orderBy(F.desc("n"), "word").limit(k)
    ranked = top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "word")))
    return ranked.crossJoin(F.broadcast(distinct))  # one row


def leakage_check(docs: DataFrame, words: Sequence[str] = tuple(fv.LEAKAGE_WORDS)) -> DataFrame:
    """Whether each listed word is among a group's tokens."""
    wide = docs.groupBy("group").agg(*[
        F.max(F.array_contains("tokens", w)).alias(w) for w in words])
    return wide.unpivot(["group"], list(words), "word", "present")


def training_metadata(docs: DataFrame, seeds: Sequence[int] = tuple(fv.SEEDS)) -> DataFrame:
    """Per group and seed: documents, sentences, tokens, vocabulary, minimum count."""
    counts = word_counts(docs)
    floors = with_min_counts(stats_from_counts(counts)).select(
        "group", "documents", "docs", "tokens", "min_count")
    sizes = (words_only(counts).join(F.broadcast(floors), "group")
             .groupBy("group", "documents", "docs", "tokens", "min_count")
             .agg(F.count_if(F.col("n") >= F.col("min_count")).alias("vocab_size")))
    return sizes.select(
        "group", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"),
        "documents", F.col("docs").alias("sentences"),
        F.col("tokens").alias("token_count"), "vocab_size", "min_count")


def mean_metadata(metadata: DataFrame) -> DataFrame:
    """Metadata averaged over seeds, in group order."""
    columns = ["documents", "sentences", "token_count", "vocab_size", "min_count"]
    means = metadata.groupBy("group").agg(*[F.avg(c).alias(c) for c in columns])
    return in_group_order(means)
