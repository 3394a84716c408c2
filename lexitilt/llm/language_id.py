"""Language identification, words first.

Each language has the log frequencies of its words. A word that the training documents hold is
scored by them in every language; an unseen word falls back to its character n-grams, the longest
order of which any is known, and scores the mean of their log frequencies. A text's language is
the one with the largest sum over its words; the score is that language's share of the softmax
of the sums.

Counts of words and n-grams are whole tables that Spark holds, with no limit on their entries.
The ``frequent`` commonest words are scored where the text lies, from a broadcast; every other
word of a text crosses once, with its count, and meets the tables in joins. Which words are
broadcast changes no result. Unseen words are scored once each, whatever number of texts has them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitilt.llm.common import durable, fold_of, released

UNKNOWN = "und"
_WORDLIKE = re.compile(r"[^\W\d_]+")
_FLUSH = 200_000


@dataclass(frozen=True)
class Settings:
    """``frequent`` is the number of words that are broadcast; all others are joined."""

    frequent: int = 100_000
    orders: tuple[int, ...] = (4, 3, 2, 1)
    folds: int = 4
    held_out_fold: int = 2


def words_of(text: str | None) -> list[str]:
    """The runs of letters (Unicode category L) of the lower-cased text."""
    words = _WORDLIKE.findall(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    # numerals such as a half or a Roman nine pass for word characters but are no letters
    return [w for run in words
            for w in "".join(c if c.isalpha() else " " for c in run).split(" ") if w]


def grams(word: Column, order: int) -> Column:
    """The ``order``-character pieces of ``word`` between boundary marks; null if it is shorter."""
    marked = F.concat(F.lit("_"), word, F.lit("_")) if order > 1 else word
    return F.when(F.length(marked) >= order, F.transform(
        F.sequence(F.lit(1), F.length(marked) - (order - 1)),
        lambda i: F.substring(marked, i, F.lit(order))))


def word_counts(training: DataFrame) -> DataFrame:
    """lang, unit, n of ``training`` (text, lang, neither null); added up in each task first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                counter = held.setdefault(lang, Counter())
                size -= len(counter)
                counter.update(words_of(text))
                size += len(counter)
                if size > _FLUSH:
                    yield from _counted(held)
                    held, size = {}, 0
        yield from _counted(held)

    return training.select("lang", "text").mapInPandas(run, "lang string, unit string, n long") \
        .groupBy("lang", "unit").agg(F.sum("n").alias("n"))


def _counted(held: dict[str, Counter]) -> Iterator[pd.DataFrame]:
    for lang, counter in held.items():
        if counter:
            yield pd.DataFrame({"lang": lang, "unit": list(counter), "n": list(counter.values())})


class Frequencies:
    """Counts of units by language, and their smoothed log frequencies as one array a unit."""

    def __init__(self, counted: DataFrame, languages: list[str]):
        self.counted, self.languages = counted, languages
        units = counted.select("unit").distinct().count()
        totals = {r["lang"]: r["n"] for r in
                  counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        self.norms = [totals.get(x, 0) + 0.5 * units + 1 for x in languages]

    def logs(self, counts: Column) -> Column:
        """The array of log frequencies for a map from language to count."""
        return F.array(*[F.log((F.coalesce(F.element_at(counts, x), F.lit(0)) + 0.5) / norm)
                         for x, norm in zip(self.languages, self.norms)])

    def table(self, counted: DataFrame | None = None) -> DataFrame:
        """unit, n (over all languages), row."""
        counts = F.map_from_entries(F.collect_list(F.struct("lang", "n")))
        return (self.counted if counted is None else counted).groupBy("unit") \
            .agg(F.sum("n").alias("n"), counts.alias("counts")) \
            .select("unit", "n", self.logs(F.col("counts")).alias("row"))


class Model:
    """Word and n-gram frequencies of the languages that were learnt."""

    def __init__(self, training: DataFrame, settings: Settings = Settings()):
        self.settings = settings
        counted = durable(word_counts(training))
        self.languages = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
        self.words = Frequencies(counted, self.languages)
        self.pieces: dict[int, Frequencies] = {}
        for order in sorted(settings.orders, reverse=True):
            found = counted.select("lang", "n", F.explode(grams(F.col("unit"), order)).alias("unit")) \
                .groupBy("lang", "unit").agg(F.sum("n").alias("n"))
            self.pieces[order] = Frequencies(durable(found), self.languages)

    def frequent(self) -> tuple[dict[str, int], np.ndarray]:
        """Places and rows of the commonest words, ties by code point; bounded by the settings."""
        top = self.words.counted.groupBy("unit").agg(F.sum("n").alias("n")) \
            .orderBy(F.desc("n"), "unit").limit(self.settings.frequent).select("unit")
        found = self.words.table(self.words.counted.join(F.broadcast(top), "unit", "left_semi")) \
            .select("unit", "row").toArrow()
        rows = np.array(found["row"].combine_chunks().flatten(), float)
        return ({w: k for k, w in enumerate(found["unit"].to_pylist())},
                rows.reshape(-1, len(self.languages)))

    def rows_of(self, words: DataFrame) -> DataFrame:
        """unit and row for each of ``words`` (unit, no value twice) that is not wholly unknown."""
        met = durable(words.join(self.words.counted, "unit", "left"))
        known = self.words.table(met.where("lang is not null")).select("unit", "row")
        rest = met.where("lang is null").select("unit")
        for order, pieces in self.pieces.items():
            mean = F.array(*[F.avg(F.col("row")[k]) for k in range(len(self.languages))])
            cut = rest.select(F.col("unit").alias("word"),
                              F.explode(grams(F.col("unit"), order)).alias("unit"))
            hits = cut.join(pieces.table().select("unit", "row"), "unit") \
                .groupBy("word").agg(mean.alias("row")).withColumnRenamed("word", "unit")
            tried = durable(rest.join(hits, "unit", "left"))
            known = known.unionByName(tried.where("row is not null"))
            rest = tried.where("row is null").select("unit")
        return known


def _split(texts: Iterable[str | None], places: dict[str, int], rows: np.ndarray
           ) -> Iterator[tuple[list[float] | None, list[str], list[int]]]:
    """For each text the sum of its frequent words' rows (None without a letter) and the rest."""
    for text in texts:
        words = words_of(text)
        if not words:
            yield None, [], []
            continue
        known = [x for w in words if (x := places.get(w)) is not None]
        rest = Counter(w for w in words if w not in places) if len(known) < len(words) else {}
        yield rows[known].sum(axis=0).tolist(), list(rest), list(rest.values())


def identify(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
             text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; one row a document.

    Learns from the documents outside the held-out fold that have a text and a language;
    predictions see the text alone. ``und`` with score 0 stands for a null text, one without
    a letter, and for every text where there was nothing to learn from. Sums are compared to
    six decimals; of equal ones the first language by code point wins. A null id is not
    held out. Repeated rows give repeated results; an empty table gives no rows; texts of any
    length are read whole; other columns are not used.
    """
    held = F.coalesce(fold_of(F.col(id_col), settings.folds) == settings.held_out_fold,
                      F.lit(False))
    kind = docs.schema[id_col].dataType
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"),
                         F.col(lang).cast("string").alias("lang"), held.alias("held_out"))
    model = Model(narrow.where(~F.col("held_out") & F.col("lang").isNotNull()
                               & F.col("text").isNotNull()).select("text", "lang"), settings)
    if not model.languages:
        return narrow.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"),
                             F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model.frequent())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = list(_split(batch["text"].tolist(), *shared.value))
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "held_out": batch["held_out"],
                **{c: pd.Series([f[k] for f in found], dtype=object)
                   for k, c in enumerate(("row", "words", "counts"))}})

    # the row number is written with the row, so every later step sees the same one
    parts = durable(narrow.select(F.col("doc_id").cast("string").alias("doc_id"), "held_out", "text")
                    .mapInPandas(run, "doc_id string, held_out boolean, row array<double>, "
                                      "words array<string>, counts array<long>")
                    .withColumn("number", F.monotonically_increasing_id()))
    rest = parts.select("number", F.explode(F.arrays_zip("words", "counts")).alias("of")) \
        .select("number", F.col("of.words").alias("unit"), F.col("of.counts").alias("n"))
    rows = released(durable(model.rows_of(rest.select("unit").distinct())))
    some = range(len(model.languages))
    crossed = rest.join(rows, "unit").select(
        "number", F.lit(None).cast("string").alias("doc_id"),
        F.lit(None).cast("boolean").alias("held_out"),
        *[(F.col("row")[k] * F.col("n")).alias(f"s{k}") for k in some])
    here = parts.select("number", "doc_id", "held_out",
                        *[F.col("row")[k].alias(f"s{k}") for k in some])
    sums = F.array(*[F.round(F.sum(f"s{k}"), 6) for k in some])
    totals = here.unionByName(crossed).groupBy("number").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), sums.alias("sums"))
    best = F.array_max("sums")
    name = F.when(best.isNotNull(), F.element_at(
        F.array(*[F.lit(x) for x in model.languages]), F.array_position("sums", best).cast("int")))
    share = 1 / F.aggregate("sums", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    return totals.select(F.col("doc_id").cast(kind).alias("doc_id"), "held_out",
                         F.coalesce(name, F.lit(UNKNOWN)).alias("lang_pred"),
                         F.round(F.coalesce(share, F.lit(0.0)), 9).alias("score"))
