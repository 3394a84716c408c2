"""Quality classifier: random-indexing word vectors, pooled, into a two-layer network.

Random indexing (Kanerva, Kristofersson & Holst, 2000): every token has a fixed sparse random
index vector, drawn from a hash of the token; a token's word vector is the sum of the index
vectors of its neighbours over all documents. There is no vocabulary: the sums are kept in
``buckets`` rows, and a token adds its own to two of them and to that of its shape (classes of
characters and length). Its vector is read from the same places: the two rows together, which
hardly any other token shares both of, and the row of its shape, which tells what a token never
met looks like. So every occurrence of every token counts, and the table has the same size for
any corpus. Each task adds up its own tokens, Spark adds up the tasks.

A document is the mean of its tokens' vectors, their spread, and the mean product of each with
the next, which repeated words drive up. A network of one hidden layer, written in numpy, is
fitted on a bounded sample of labelled rows (``sample_rows``) and its probabilities are
calibrated by a temperature on a part of the sample that it has not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitilt.llm.common import bounded_sample, fold_of

TOKEN = r"\w+|[^\w\s]+"
_TOKEN = re.compile(TOKEN)
_CHUNK = 100_000
_CACHE = 300_000


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    size: int = 48
    nonzero: int = 4
    reach: int = 2
    hidden: int = 24
    sample_rows: int = 8000
    epochs: int = 120
    folds: int = 5
    held_out_fold: int = 0
    threshold: float = 0.3
    seed: int = 1


def shape_of(token: str) -> str:
    """Classes of a token's characters, runs as one, and its length up to 15."""
    if token.isalpha() and token.islower():  # most tokens; the loop would say the same
        return f"x{min(len(token), 15)}"
    out: list[str] = []
    for c in token[:64]:
        kind = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return f"{''.join(out)}{min(len(token), 15)}"


def marks_of(token: str) -> tuple[int, int]:
    """Hashes of a token and of its shape."""
    return (xxhash.xxh64_intdigest(token, 0), xxhash.xxh64_intdigest(shape_of(token), 1))


class _Numbers(dict):
    """Counts up the different tokens that are looked up."""

    def __missing__(self, token: str) -> int:
        self[token] = number = len(self)
        return number


@dataclass
class Chunk:
    """Tokens of whole texts by number; ``starts`` of the texts in them. ``fresh`` are the marks of
    the tokens first met here; where ``first`` is set, numbers start anew with this chunk."""

    ids: np.ndarray
    starts: np.ndarray
    rows: list[int]
    fresh: np.ndarray
    first: bool


class Reader:
    """Cuts texts into numbered tokens; forgets the numbers when there are too many."""

    def __init__(self) -> None:
        self.numbers, self.told = _Numbers(), 0

    def chunks(self, texts: list[str | None]) -> Iterator[Chunk]:
        ids: list[int] = []
        starts: list[int] = []
        rows: list[int] = []
        for k, text in enumerate(texts):
            tokens = _TOKEN.findall(text) if text else []
            if not tokens:
                continue
            starts.append(len(ids))
            rows.append(k)
            ids.extend(map(self.numbers.__getitem__, tokens))
            if len(ids) > _CHUNK or len(self.numbers) > _CACHE:
                yield self._chunk(ids, starts, rows)
                ids, starts, rows = [], [], []
                if len(self.numbers) > _CACHE:
                    self.numbers, self.told = _Numbers(), 0
        if rows:
            yield self._chunk(ids, starts, rows)

    def _chunk(self, ids: list[int], starts: list[int], rows: list[int]) -> Chunk:
        fresh = [marks_of(t) for t in islice(self.numbers, self.told, None)]
        first, self.told = not self.told, len(self.numbers)
        return Chunk(np.array(ids), np.array(starts), rows,
                     np.array(fresh, np.uint64).reshape(-1, 2), first)


class Grown:
    """A row for each numbered token of a reader, worked out when the token is first met."""

    def __init__(self, size: int, kind: type):
        self.held, self.n = np.zeros((1024, size), kind), 0

    def add(self, chunk: Chunk, rows: np.ndarray) -> np.ndarray:
        if chunk.first:
            self.n = 0
        end = self.n + len(rows)
        if end > len(self.held):
            more = np.zeros((max(end, 2 * len(self.held)), self.held.shape[1]), self.held.dtype)
            more[:self.n] = self.held[:self.n]
            self.held = more
        self.held[self.n:end] = rows
        self.n = end
        return self.held[:end]


def index_vectors(marks: np.ndarray, settings: Settings) -> np.ndarray:
    """The index vector of each token: ``nonzero`` signs at places its hash draws."""
    out = np.zeros((len(marks), settings.size), np.int8)
    each, state = np.arange(len(marks)), marks[:, 0].copy()
    for _ in range(settings.nonzero):
        state = state * np.uint64(6364136223846793005) + np.uint64(1442695040888963407)
        place = ((state >> np.uint64(33)) % np.uint64(settings.size)).astype(np.int64)
        out[each, place] += np.where(state >> np.uint64(32) & np.uint64(1), 1, -1)
    return out


def places(marks: np.ndarray, settings: Settings) -> np.ndarray:
    """Three rows of the table of sums for each token: two of its own, one of its shape."""
    n = np.uint64(settings.buckets)
    return np.stack([(marks[:, 0] >> np.uint64(32)) % n,
                     (marks[:, 0] & np.uint64(0xFFFFFFFF)) % n, marks[:, 1] % n]).astype(np.int64)


def _summed(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different entries of ``at`` and the sums of their rows of ``values``."""
    order = np.argsort(at, kind="stable")
    ordered = at[order]
    starts = np.concatenate(([0], np.nonzero(np.diff(ordered))[0] + 1))
    return ordered[starts], np.add.reduceat(values[order], starts)


def neighbour_sums(chunk: Chunk, index: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Different tokens, and for each the sum of ``index`` over its neighbours within one text.

    Texts stand with ``reach`` empty places between them, so no neighbour is of another text.
    """
    texts = np.repeat(np.arange(len(chunk.starts)),
                      np.diff(np.append(chunk.starts, len(chunk.ids))))
    at = np.arange(len(chunk.ids)) + (texts + 1) * reach
    wide = np.zeros((len(at) + (len(chunk.starts) + 1) * reach, index.shape[1]), index.dtype)
    wide[at] = index[chunk.ids]
    around = np.zeros_like(wide)
    for k in range(1, reach + 1):
        around[k:] += wide[:-k]
        around[:-k] += wide[k:]
    order = np.argsort(chunk.ids, kind="stable")
    ordered = chunk.ids[order]
    starts = np.concatenate(([0], np.nonzero(np.diff(ordered))[0] + 1))
    return ordered[starts], np.add.reduceat(around[at[order]].astype(np.float32), starts)


def task_sums(batches: Iterator[list[str | None]], settings: Settings) -> np.ndarray:
    """The table of sums over some texts, ``buckets`` rows."""
    reader, total = Reader(), np.zeros((settings.buckets, settings.size))
    marks, index = Grown(2, np.uint64), Grown(settings.size, np.int8)
    sums = Grown(settings.size, np.float64)

    def settle() -> None:
        if sums.n:
            for place in places(marks.held[:marks.n], settings):
                rows, more = _summed(place, sums.held[:sums.n])
                total[rows] += more

    for texts in batches:
        for chunk in reader.chunks(texts):
            if chunk.first:
                settle()
            marks.add(chunk, chunk.fresh)
            known = index.add(chunk, index_vectors(chunk.fresh, settings))
            held = sums.add(chunk, np.zeros((len(chunk.fresh), settings.size)))
            tokens, more = neighbour_sums(chunk, known, settings.reach)
            held[tokens] += more
    settle()
    return total


def bucket_sums(docs: DataFrame, settings: Settings) -> np.ndarray:
    """The table of sums over all documents, each task's own added up by Spark."""
    columns = [f"c{k}" for k in range(settings.size)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = task_sums((batch["text"].tolist() for batch in batches), settings)
        seen = np.nonzero(np.abs(total).sum(axis=1))[0]
        out = pd.DataFrame(total[seen].astype(np.int64), columns=columns)
        out.insert(0, "place", seen)
        yield out

    found = docs.select("text").mapInPandas(
        run, ", ".join(["place long", *[f"{c} long" for c in columns]])) \
        .groupBy("place").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    out = np.zeros((settings.buckets, settings.size), np.float32)
    if found.num_rows:
        out[found["place"].to_numpy()] = np.stack([found[c].to_numpy() for c in columns], axis=1)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def token_vectors(marks: np.ndarray, sums: np.ndarray, settings: Settings) -> np.ndarray:
    """What a token's own two rows say, and what its shape says, in equal parts."""
    first, second, shape = places(marks, settings)
    return (_unit(sums[first] + sums[second]) + _unit(sums[shape])) / 2


def pooled(texts: list[str | None], reader: Reader, vectors: Grown, sums: np.ndarray,
           settings: Settings) -> np.ndarray:
    """A row a text: mean, spread, mean product with the next token; NaN without tokens."""
    out = np.full((len(texts), 3 * settings.size), np.nan, np.float32)
    for chunk in reader.chunks(texts):
        starts = chunk.starts
        x = vectors.add(chunk, token_vectors(chunk.fresh, sums, settings))[chunk.ids]
        n = np.diff(np.append(starts, len(x)))[:, None]
        mean = np.add.reduceat(x, starts) / n
        square = np.add.reduceat(x * x, starts) / n
        following = np.zeros_like(x)
        following[:-1] = x[:-1] * x[1:]
        following[starts[1:] - 1] = 0  # the last token of a text is followed by none
        product = np.add.reduceat(following, starts) / np.maximum(n - 1, 1)
        out[chunk.rows] = np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0)), product])
    return out


class Network:
    """Two layers in numpy: standardised input, tanh, one logit over a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, settings: Settings):
        rng = np.random.default_rng(settings.seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.temperature = 1.0
        width = x.shape[1]
        self.p = [rng.normal(0, width ** -0.5, (width, settings.hidden)),
                  np.zeros(settings.hidden),
                  rng.normal(0, settings.hidden ** -0.5, settings.hidden), np.zeros(1)]
        check = np.arange(len(y)) % 5 == 0 if len(y) >= 50 else np.zeros(len(y), bool)
        self._fit((x[~check] - self.mean) / self.scale, y[~check], settings, rng)
        if check.any():
            self._calibrate(self.logits(x[check]), y[check])

    def _fit(self, x: np.ndarray, y: np.ndarray, settings: Settings,
             rng: np.random.Generator) -> None:
        """Adam on the mean cross-entropy with a small weight decay."""
        first = [np.zeros_like(p) for p in self.p]
        second = [np.zeros_like(p) for p in self.p]
        step = 0
        for _ in range(settings.epochs):
            for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 256)):
                step += 1
                w1, b1, w2, b2 = self.p
                h = np.tanh(x[rows] @ w1 + b1)
                d = (_sigmoid(h @ w2 + b2) - y[rows]) / len(rows)
                back = d[:, None] * w2 * (1 - h * h)
                grads = [x[rows].T @ back + 1e-3 * w1, back.sum(axis=0),
                         h.T @ d + 1e-3 * w2, d.sum(keepdims=True)]
                for k, g in enumerate(grads):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - 0.003 * (first[k] / (1 - 0.9 ** step)) / (
                        np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)

    def _calibrate(self, logits: np.ndarray, y: np.ndarray) -> None:
        """The temperature, of a fixed grid, with the least cross-entropy."""

        def loss(t: float) -> float:
            p = np.clip(_sigmoid(logits / t), 1e-6, 1 - 1e-6)
            return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

        self.temperature = min((float(t) for t in np.geomspace(0.25, 8, 61)), key=loss)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.p
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Classifier:
    """All that scoring needs; broadcast to the tasks. Its size is set by the settings."""

    def __init__(self, sums: np.ndarray, network: Network | None, settings: Settings):
        self.sums, self.network, self.settings = sums, network, settings

    def scores(self, texts: list[str | None], reader: Reader, vectors: Grown) -> np.ndarray:
        x = pooled(texts, reader, vectors, self.sums, self.settings)
        has = ~np.isnan(x[:, 0])
        out = np.zeros(len(texts))
        out[has] = self.network.probability(x[has]) if self.network is not None else 0.5
        return out


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(),
          id_col: str = "doc_id", text: str = "text", label_id: str = "doc_id",
          label: str = "quality") -> Classifier:
    """Vectors from all of ``docs``, the network from a sample of rows outside the held-out
    fold. Without labelled rows there is no network and every text with a token scores 0.5.
    A labelled id with several texts counts once, by the least of their pooled rows."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    sums = bucket_sums(narrow.where("text is not null"), settings)
    known = labels.select(F.col(label_id).alias("doc_id"), F.col(label).alias("label")) \
        .where(F.col("label").isNotNull()
               & (fold_of(F.col("doc_id"), settings.folds) != settings.held_out_fold)) \
        .groupBy("doc_id").agg(F.avg("label").alias("label"))
    sample = bounded_sample(known, "doc_id", settings.sample_rows, settings.seed)
    shared = docs.sparkSession.sparkContext.broadcast(sums)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, vectors = Reader(), Grown(settings.size, np.float32)
        for batch in batches:
            x = pooled(batch["text"].tolist(), reader, vectors, shared.value, settings)
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "x": list(x)})[
                ~np.isnan(x[:, 0])]

    # a sample of bounded size, so the documents stay where they are
    rows = narrow.join(F.broadcast(sample), "doc_id") \
        .select(F.col("doc_id").cast("string").alias("id"), "label", "text") \
        .mapInPandas(run, "id string, label double, x array<float>") \
        .groupBy("id").agg(F.min("label").alias("label"), F.min("x").alias("x")) \
        .orderBy("id").toArrow()
    if not rows.num_rows:
        return Classifier(sums, None, settings)
    x = np.stack(rows["x"].to_numpy()).astype(float)
    y = (rows["label"].to_numpy() >= 0.5).astype(float)
    return Classifier(sums, Network(x, y, settings), settings)


def score(docs: DataFrame, classifier: Classifier, settings: Settings = Settings(),
          id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted; one row a document.

    A null or empty text, or one without a token, scores 0 and is predicted 0. A null id is
    not held out. Repeated rows give repeated results; an empty table gives no rows; texts of
    any length are read whole; other columns are not used.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, vectors = Reader(), Grown(settings.size, np.float32)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"],
                                "score": shared.value.scores(batch["text"].tolist(), reader, vectors)})

    kind = docs.schema[id_col].dataType
    found = docs.select(F.col(id_col).cast("string").alias("doc_id"),
                        F.col(text).alias("text")).mapInPandas(run, "doc_id string, score double")
    held = F.coalesce(fold_of(F.col("doc_id"), settings.folds) == settings.held_out_fold,
                      F.lit(False))
    return found.select(F.col("doc_id").cast(kind).alias("doc_id"), held.alias("held_out"),
                        "score", (F.col("score") >= settings.threshold).cast("int")
                        .alias("predicted"))


def keep_good(docs: DataFrame, classifier: Classifier, settings: Settings = Settings(),
              text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score at or above the threshold.

    A null or empty text scores 0 and goes. Equal rows fare alike; columns may have any name.
    """
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, vectors = Reader(), Grown(settings.size, np.float32)
        for batch in batches:
            good = shared.value.scores(batch.column(at).to_pylist(), reader, vectors) \
                >= settings.threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
