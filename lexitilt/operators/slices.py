"""Tables of vectors cut into slices of coordinates, for whole vocabularies and their grams.

No coordinate of a vector meets another when gram vectors are fitted (``grams.fit``), when words are
made of them or of means (``grams.composed``, ``vectors.compose_subwords``), or when both are held
against the words (``grams.reconstruction``). Given a ``Cut``, these only note what is to be done, but
for the last: there a task takes some coordinates of a group's words from the first step to the last,
so vectors cross the shuffle once, and neither states nor gram vectors are written. A task holds a
slice of ``SLICE_BYTES`` (a few times, for the steps) and its group's links, four bytes a gram of a
word. Slices of a group lie in lanes; a lane gets the links once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitilt.operators.company import by_unit, in_units, spread, squeezed
from lexitilt.operators.vectors import subwords
from lexitilt.sources.staging import materialize, released

if TYPE_CHECKING:
    from lexitilt.operators.grams import Ridge

SLICE_BYTES = 1 << 23
LANES = 8
#: Words whose slices are sent together.
_PIECE = 2048
#: Sums worked out side by side, and terms above which a sum is worked out alone.
_SIDE = 512
_DEEP = 48

_LINKS = ["ids", "n", "real", "sizes", "grams", "buckets"]
_KINDS = ["<i8", "<i8", "<i1", "<i4", "<i4", "<i4"]


def gram_links(words: DataFrame, config: Ridge) -> DataFrame:
    """group, words (how many) and, packed: ids (ascending) and n of the words, real (0 for a word
    that has no gram but itself), sizes (grams a word), grams (of each word, numbered in the group),
    buckets (of each gram, numbered in the group). ``words``: group, word, n, no word twice."""
    found = subwords(F.col("word"), config.min_n, config.max_n)
    real = F.size(found) > 0
    own = F.when(real, found).otherwise(F.array(F.concat(F.lit("<"), "word", F.lit(">"))))
    buckets = config.buckets

    def result(group: str, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts)
        ids, n, real = (whole[c].to_numpy() for c in ("id", "n", "real"))
        hashes = np.concatenate([p["hashes"].flatten().to_numpy() for p in parts])
        sizes = np.concatenate([p["hashes"].value_lengths().to_numpy() for p in parts])
        names, grams = np.unique(hashes, return_inverse=True)
        packed = zip((ids, n, real, sizes, grams, np.unique(names % buckets, return_inverse=True)[1]), _KINDS)
        return pa.RecordBatch.from_arrays(
            [pa.array([group]), pa.array([len(ids)]),
             *[pa.array([squeezed(a.astype(kind).tobytes())]) for a, kind in packed]], ["group", "words", *_LINKS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for at, part in by_unit(batches, ("group",)):
            if at != key and held:
                yield result(key[0], held)
                held = []
            key = at
            held.append(part)
        if held:
            yield result(key[0], held)

    rows = words.select("group", F.xxhash64("word").alias("id"), F.col("n").cast("long").alias("n"),
                        real.cast("tinyint").alias("real"), F.transform(own, lambda g: F.xxhash64(g)).alias("hashes"))
    return rows.repartition("group").sortWithinPartitions("group", "id").mapInArrow(
        run, "group string, words long, " + ", ".join(f"{c} binary" for c in _LINKS))


class _Sums:
    """Sums of rows that belong together: row i is that of ``rows[starts[i]:starts[i + 1]]``, no sum
    empty. Sums of about as many terms lie side by side and take their next terms together."""

    def __init__(self, rows: np.ndarray, starts: np.ndarray):
        sizes = np.diff(starts)
        order = np.argsort(-sizes, kind="stable")
        self.place = np.argsort(order)
        sizes, first = sizes[order], starts[:-1][order]
        self.deep = [rows[a:a + n] for a, n in zip(first, sizes[:int((sizes > _DEEP).sum())])]
        self.blocks = []
        for k in range(len(self.deep), len(sizes), _SIDE):
            own, at = sizes[k:k + _SIDE], first[k:k + _SIDE]
            self.blocks.append((k, [rows[at[:int((own > term).sum())] + term] for term in range(own[0])]))

    def of(self, values: np.ndarray) -> np.ndarray:
        out = np.empty((len(self.place), values.shape[1]))
        for k, rows in enumerate(self.deep):
            values.take(rows, axis=0, mode="clip").sum(axis=0, out=out[k])
        for k, terms in self.blocks:
            values.take(terms[0], axis=0, out=out[k:k + len(terms[0])], mode="clip")
            for rows in terms[1:]:
                out[k:k + len(rows)] += values.take(rows, axis=0, mode="clip")
        return out.take(self.place, axis=0)


def _both(at: np.ndarray, sizes: np.ndarray) -> tuple[_Sums, _Sums]:
    """Sums by word of what lies at ``at``, and sums there of the words."""
    word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    order = np.argsort(at, kind="stable")
    starts = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    there = np.concatenate(([0], np.cumsum(np.bincount(at))))
    return _Sums(at, starts), _Sums(word[order], there)


class _Links:
    """A group's links, unpacked."""

    def __init__(self, row: dict):
        ids, n, real, sizes, grams, buckets = (
            np.frombuffer(spread(row[c]), kind) for c, kind in zip(_LINKS, _KINDS))
        self.ids, self.sizes = ids, sizes[:, None].astype(np.float64)
        self.by_word, self.by_bucket = _both(buckets[grams], sizes)
        self.real = np.flatnonzero(real)
        kept = np.repeat(real, sizes) > 0
        seen, grams = np.unique(grams[kept], return_inverse=True)
        self.gram_words, self.by_gram = _both(grams, sizes[self.real])
        self.n = n[:, None].astype(np.float64)
        self.gram_n = self.by_gram.of(self.n[self.real]) if len(seen) else np.zeros((0, 1))


def solved(links: _Links, x: np.ndarray, config: Ridge) -> np.ndarray:
    """The buckets' vectors after all steps of conjugate gradients (see ``grams.fit``)."""
    share = 1 / links.sizes
    r = links.by_bucket.of(x * share)
    z, p = np.zeros_like(r), r.copy()
    for _ in range(config.steps):
        s = links.by_word.of(p)
        s *= share ** 2
        s = links.by_bucket.of(s)
        s += config.ridge * p
        rr, ps, rs, ss = (np.einsum("ij,ij->j", a, b) for a, b in ((r, r), (p, s), (r, s), (s, s)))
        alpha = np.divide(rr, ps, out=np.zeros_like(rr), where=ps > 0)
        left = np.maximum(rr - 2 * alpha * rs + alpha ** 2 * ss, 0)
        beta = np.divide(left, rr, out=np.zeros_like(rr), where=rr > 0)
        z += alpha * p
        r -= alpha * s
        p *= beta
        p += r
    return z


def composed(links: _Links, z: np.ndarray, config: Ridge) -> np.ndarray:
    """The words as the means of their buckets."""
    return links.by_word.of(z) / links.sizes


def means(links: _Links, x: np.ndarray, config: Ridge) -> np.ndarray:
    """The words as the means of themselves and their grams (see ``vectors.compose_subwords``)."""
    out = x.copy()
    if len(links.real):
        grams = links.by_gram.of((x * links.n)[links.real]) / links.gram_n
        out[links.real] = (x[links.real] + links.gram_words.of(grams)) / (1 + links.sizes[links.real])
    return out


_STEPS = {f.__name__: f for f in (solved, composed, means)}


@dataclass(frozen=True)
class Cut:
    """A table of vectors in slices, and what is made of it: names in ``_STEPS``, one after the other.
    rows: group, lane, slice, a lane's links first, and of slices seed, known (ids of words), x."""

    rows: DataFrame
    firsts: DataFrame
    units: int
    columns: int
    config: Ridge
    steps: tuple[str, ...] = ()

    def then(self, step: str) -> Cut:
        return replace(self, steps=(*self.steps, step))


def cut(table: DataFrame, links: DataFrame, config: Ridge) -> Cut:
    """``table``: group, seed, word, vector; ``links``: the staged ``gram_links`` of its vocabulary."""
    size = config.vector_size
    groups = sorted((r["group"], r["words"]) for r in links.select("group", "words").collect())  # a row a group
    columns = max(1, min(size, SLICE_BYTES // (8 * max([1, *[n for _, n in groups]]))))
    slices = -(-size // columns)
    lanes = min(LANES, slices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (group, seed), rows in ((at, part.slice(k, _PIECE)) for at, part in by_unit(batches, ("group", "seed"))
                                    for k in range(0, len(part), _PIECE)):
            ids = rows["id"].to_numpy().tobytes()
            x = rows["vector"].flatten().to_numpy().reshape(-1, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array([group] * slices), pa.array([seed] * slices, pa.int32()),
                 pa.array([k % lanes for k in range(slices)], pa.int32()), pa.array(range(slices), pa.int32()),
                 pa.array([ids] * slices),
                 pa.array([x[:, k * columns:(k + 1) * columns].tobytes() for k in range(slices)])],
                ["group", "seed", "lane", "slice", "known", "x"])

    pieces = (table.select("group", "seed", F.xxhash64("word").alias("id"),
                           F.col("vector").cast("array<double>").alias("vector"))
              .mapInArrow(run, "group string, seed int, lane int, slice int, known binary, x binary"))
    rows = links.select("group", F.explode(F.array(*[F.lit(k) for k in range(lanes)])).alias("lane"),
                        F.lit(-1).alias("slice"), *_LINKS).unionByName(pieces, allowMissingColumns=True)
    firsts = table.sparkSession.createDataFrame(
        [(g, k * lanes) for k, (g, _) in enumerate(groups)], "group string, first long")
    return Cut(rows, firsts, len(groups) * lanes, columns, config)


def reconstruction(made: Cut) -> DataFrame:
    """group, seed, words, error: how far what is made is from the table that was cut."""
    config, columns, steps = made.config, made.columns, made.steps

    def result(key: tuple, own: _Links, x: np.ndarray) -> pa.RecordBatch:
        values = x
        for step in steps:
            values = _STEPS[step](own, values, config)
        values = values - x
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([len(x)]),
             pa.array([float(np.vdot(x, x))]), pa.array([float(np.vdot(values, values))])],
            ["group", "seed", "words", "square", "gap"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, x = None, None, None
        for at, rows in by_unit(batches, ("group", "seed", "slice")):
            for row in (rows.slice(k, 1).to_pylist()[0] for k in range(len(rows))):
                if at != key and x is not None:
                    yield result(key, own, x)
                    x = None
                key = at
                if row["slice"] < 0:  # a lane's links come first
                    own = _Links(row)
                    continue
                if x is None:
                    x = np.zeros((len(own.ids), min(columns, config.vector_size - row["slice"] * columns)))
                place = np.searchsorted(own.ids, np.frombuffer(row["known"], np.int64))
                x[place] = np.frombuffer(row["x"]).reshape(len(place), -1)
        if x is not None:
            yield result(key, own, x)

    sums = in_units(made.rows, made.firsts, made.units, "lane", "slice", "seed").mapInArrow(
        run, "group string, seed int, words long, square double, gap double")
    return released(materialize(sums.groupBy("group", "seed").agg(
        F.max("words").alias("words"), (F.sum("gap") / F.sum("square")).alias("error")), "errors"))
