"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity grades 0 to K are ordered: P(grade >= k) = sigmoid(w.x - theta_k), one weight vector
for all K thresholds. Features are a text's lower-cased words and the first letters of longer
words, each with the logarithm of one plus its count; an L1 penalty leaves weights on few of
them. The result is the expected severity, the sum of P(grade >= k) over k.

The model is fitted on a bounded sample of labelled rows (``sample_rows``, half of them toxic
where there are as many) and on the ``max_features`` of its features that tell toxic texts best, and its first threshold is moved back to the shares of all labelled
rows. Where labels only say toxic or not, ``graded`` grades the toxic ones by how many words of
the toxic vocabulary they hold.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitilt.llm.common import bounded_sample, durable

_LETTERS = re.compile(r"[^\W\d_]+")
_CACHE = 300_000


@dataclass(frozen=True)
class Settings:
    grades: int = 3
    prefix: int = 5
    sample_rows: int = 8000
    max_features: int = 2000
    min_documents: int = 3
    penalty: float = 0.0002
    steps: int = 1200
    words_of_grade: tuple[int, ...] = (3, 7)
    seed: int = 3


def features_of(word: str, prefix: int) -> list[int]:
    """Stable numbers of a word's features: itself and, if it is longer, its beginning."""
    out = [xxhash.xxh64_intdigest(word) >> 1]
    if len(word) > prefix:
        out.append(xxhash.xxh64_intdigest("^" + word[:prefix]) >> 1)
    return out


def counts_of(text: str | None, prefix: int) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(_LETTERS.findall(text.lower()) if text else ()).items():
        for f in features_of(word, prefix):
            out[f] += n
    return out


def graded(toxic: np.ndarray, hits: np.ndarray, settings: Settings) -> np.ndarray:
    """Grade 0 where not toxic, else 1 and one more for each of ``words_of_grade`` reached by
    ``hits``, the count of toxic vocabulary in the text."""
    return np.where(toxic, 1 + sum((hits >= w).astype(int) for w in settings.words_of_grade), 0)


class Ordinal:
    """Weights of features and ordered thresholds."""

    def __init__(self, features: list[int], weights: np.ndarray, thresholds: np.ndarray,
                 prefix: int):
        kept = np.nonzero(weights)[0]
        self.weights = {features[k]: float(weights[k]) for k in kept}
        self.thresholds = thresholds
        self.prefix = prefix

    def score(self, text: str | None, cache: dict) -> float:
        """w.x; ``cache`` maps a word to those of its features that have a weight."""
        if not text:
            return 0.0
        found: Counter = Counter()
        for word in _LETTERS.findall(text.lower()):
            if (hit := cache.get(word)) is None:
                if len(cache) > _CACHE:
                    cache.clear()
                hit = cache[word] = [f for f in features_of(word, self.prefix)
                                     if f in self.weights]
            for f in hit:
                found[f] += 1
        return sum(self.weights[f] * np.log1p(n) for f, n in sorted(found.items()))

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K: a row a score."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(features: list[int], r: np.ndarray, c: np.ndarray, v: np.ndarray, grades: np.ndarray,
        settings: Settings) -> Ordinal:
    """The penalised maximum-likelihood model, by proximal gradient steps with momentum.

    Text ``r`` has the value ``v`` in feature ``c``, the place of a feature in ``features``.
    A step is halved until the loss falls as its slopes say: where a grade has few texts, its two
    thresholds nearly meet and the slopes hold for short ways only.
    """
    w, u = np.zeros(len(features)), np.zeros(len(features))
    at = np.array([(grades >= k).mean() for k in range(1, settings.grades + 1)])
    at = np.clip(at, 1e-4, 1 - 1e-4)
    theta = np.log((1 - at) / at)
    n, momentum = len(grades), 1.0
    step = 4.0 / max(1e-9, np.bincount(r, v * v, n).mean() * 4) if len(features) else 0.0
    edge = np.arange(settings.grades + 1)

    def chances(weights: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(grade >= k) from 0 on, P(grade) of each text's own, and the loss."""
        s = np.bincount(r, weights[c] * v, n)
        upper = np.hstack([np.ones((n, 1)), _sigmoid(s[:, None] - thresholds), np.zeros((n, 1))])
        here = upper[np.arange(n), grades] - upper[np.arange(n), grades + 1] + 1e-12
        return upper, here, -np.log(here).mean()

    share, last = 1.0, np.inf
    for _ in range(settings.steps if len(features) else 0):
        upper, here, loss = chances(u, theta)
        # d log P(grade) / ds is 1 - F_k - F_(k+1) for the logistic link
        slope = 1 - upper[np.arange(n), grades] - upper[np.arange(n), grades + 1]
        gradient = -np.bincount(c, slope[r] * v, len(features)) / n
        move = np.zeros(settings.grades + 2)
        for k in edge[1:]:
            density = upper[:, k] * (1 - upper[:, k]) / here
            move[k] = (density * ((grades == k - 1).astype(int) - (grades == k))).mean()
        move = move[1:-1]
        share = min(1.0, share * 1.05)
        while True:
            new = u - share * step * gradient
            new = np.sign(new) * np.maximum(np.abs(new) - share * step * settings.penalty, 0)
            moved = np.maximum.accumulate(theta + share * 0.5 * move)
            dw, dt = new - u, moved - theta
            found = chances(new, moved)[2]
            if share < 1e-9 or found <= loss + gradient @ dw - move @ dt + (
                    dw @ dw / step + dt @ dt / 0.5) / (2 * share) + 1e-9:
                break
            share /= 2
        total = found + settings.penalty * np.abs(new).sum()
        if total > last:  # momentum led uphill: it starts anew
            u, momentum = new, 1.0
        else:
            following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
            u, momentum = new + (momentum - 1) / following * (new - w), following
        w, theta, last = new, moved, total
    return Ordinal(features, w, theta, settings.prefix)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(),
          id_col: str = "doc_id", text: str = "text", label_id: str = "doc_id",
          label: str = "toxic") -> Ordinal | None:
    """The model of a bounded sample of the labelled documents; None without both classes.

    ``label`` is 0 for not toxic; where it is more than 1 anywhere it is the grade itself. Of
    several texts of one id the least counts. Features are counted and chosen in Spark: the driver
    holds the ``max_features`` chosen and their values in the sampled texts, however long those are.
    """
    known = labels.select(F.col(label_id).alias("doc_id"), F.col(label).alias("label")) \
        .where("doc_id is not null and label is not null") \
        .groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    shares = known.agg(F.count("*").alias("n"), F.coalesce(
        F.sum((F.col("label") > 0).cast("long")), F.lit(0)).alias("bad"),
        F.max("label").alias("top")).first()
    if not shares["bad"] or shares["bad"] == shares["n"]:
        return None
    half = settings.sample_rows // 2
    sample = bounded_sample(known.where("label > 0"), "doc_id", half, settings.seed).unionByName(
        bounded_sample(known.where("label <= 0"), "doc_id", half, settings.seed))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = [counts_of(t, settings.prefix) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"],
                                "features": [list(c) for c in counts],
                                "counts": [list(c.values()) for c in counts]})

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    rows = durable(
        narrow.where("text is not null").join(F.broadcast(sample), "doc_id")
        .groupBy(F.col("doc_id").cast("string").alias("id"), "label").agg(F.min("text").alias("text"))
        .mapInPandas(run, "id string, label int, features array<long>, counts array<int>"))
    known_rows = rows.select("id", "label").orderBy("id").collect()  # sample_rows at most
    ids, found = [r["id"] for r in known_rows], np.array([r["label"] for r in known_rows])
    bad, good = int((found > 0).sum()), int((found <= 0).sum())
    if not bad or not good:
        return None
    cells = rows.select("id", "label", F.explode(F.arrays_zip("features", "counts")).alias("c")) \
        .select("id", "label", F.col("c.features").alias("f"), F.col("c.counts").alias("n"))
    spread = durable(
        cells.groupBy("f").agg(F.count("*").alias("texts"), F.count_if(F.col("label") > 0).alias("bad"))
        .where(F.col("texts") >= settings.min_documents))
    # the features whose document counts among graded texts are furthest from chance
    pull = F.abs(F.col("bad") - F.col("texts") * F.lit(bad / len(ids))) / F.sqrt("texts")
    features = [r["f"] for r in spread.orderBy(pull.desc(), "f").limit(settings.max_features)
                .select("f").collect()]
    places = docs.sparkSession.createDataFrame(list(zip(features, range(len(features)))), "f long, k int")
    held = cells.join(F.broadcast(places), "f").select("id", "k", "n").toArrow()
    if shares["top"] > 1:
        grades = np.clip(found, 0, settings.grades)
    else:
        # features in some toxic texts and twenty times as frequent among those as among others
        words = spread.where((F.col("bad") >= settings.min_documents) & (
            F.col("bad") / bad >= 20 * (F.col("texts") - F.col("bad") + 0.5) / good)).select("f")
        hits = {r["id"]: r["n"] for r in cells.where("label > 0").join(words, "f")
                .groupBy("id").agg(F.sum("n").alias("n")).collect()}
        grades = graded(found > 0, np.array([hits.get(i, 0) for i in ids]), settings)
    at = pd.Categorical(held["id"].to_pandas(), categories=ids).codes.astype(np.int64)
    model = fit(features, at, held["k"].to_numpy().astype(np.int64),
                np.log1p(held["n"].to_numpy().astype(float)), grades, settings)
    # the sample holds more toxic rows than the labels do: move the odds back
    sampled = bad / good
    model.thresholds = model.thresholds + np.log(
        sampled * (shares["n"] - shares["bad"]) / shares["bad"])
    return model


def severity(docs: DataFrame, model: Ordinal | None, id_col: str = "doc_id",
             text: str = "text") -> DataFrame:
    """doc_id, expected_severity (0 to K), p_toxic, grade (the likeliest), toxic; a row a
    document.

    A null or empty text has no features and gets the base rate of the thresholds. Without a
    model (labels of one class only) everything is 0 and not toxic. Repeated rows give
    repeated results; an empty table gives no rows; other columns are not used.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        held = shared.value
        for batch in batches:
            n = len(batch)
            up = np.zeros((n, 1)) if held is None else held.at_least(
                np.array([held.score(t, cache) for t in batch["text"]], float))
            each = np.hstack([1 - up[:, :1], up[:, :-1] - up[:, 1:], up[:, -1:]])
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "expected_severity": up.sum(axis=1),
                "p_toxic": up[:, 0], "grade": each.argmax(axis=1).astype("int32"),
                "toxic": up[:, 0] >= 0.5})

    kind = docs.schema[id_col].dataType
    found = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text).alias("text")) \
        .mapInPandas(run, "doc_id string, expected_severity double, p_toxic double, grade int, "
                          "toxic boolean")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))
