"""Dense vectors of whole vocabularies, worked out by parts.

The same vectors as ``vectors.dense_vectors`` of ``vectors.ppmi_vectors`` without a word list, but
from the pairs that ``company`` keeps by parts: a context's signs are hashed once and sent, each
once and as bits, to the parts whose pairs meet them, where a word's row is summed in one place. So
neither pairs nor signed weights cross a shuffle as rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitilt.functions import fixed_values as fv
from lexitilt.operators.company import Company, by_unit, unpack
from lexitilt.operators.vectors import SIGN_BITS, TrainingConfig, sign_bits

#: Contexts whose signs are doubles at a time.
_MET = 512
#: Words whose vectors are given on together.
_GIVEN = 2048
_SENT = "group string, part int, source int, signs binary"


def _sent_signs(rows: DataFrame, planes: int) -> DataFrame:
    """group, part, source, signs: to each part the bits of the contexts that its pairs meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                group, part, dests = (batch[c][k].as_py() for c in ("group", "part", "dests"))
                signs = batch["signs"][k].values.to_numpy().reshape(planes, -1)
                for dest, places in zip(dests, batch["places"][k]):
                    at = np.frombuffer(places.as_buffer(), "<u2")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([group]), pa.array([dest], pa.int32()), pa.array([part], pa.int32()),
                         pa.array([signs[:, at].tobytes()], pa.binary())], ["group", "part", "source", "signs"])

    return rows.select("group", "part", "dests", "places", "signs").mapInArrow(run, _SENT)


class _Part:
    """A part's pairs, and the signs of their contexts as they come in."""

    def __init__(self, row: dict, planes: int):
        near, ctx_near = np.frombuffer(row["near"]), np.frombuffer(row["ctx_near"])
        keys, n = unpack(row["pairs"])
        self.at = (keys & 0xFFFFFFFF).astype(np.int32)
        keys >>= 32  # now the place; in place, for the memory of what lies between
        self.starts = np.searchsorted(keys, np.arange(len(near) + 1))
        both = near[keys]
        both *= ctx_near[self.at]
        self.weight = n * row["total"]
        self.weight /= both
        np.log(self.weight, out=self.weight)
        self.words, self.n = pa.array(row["words"], pa.string()), pa.array(row["n"], pa.int64())
        self.signs, self.filled = np.zeros((planes, len(ctx_near)), np.int64), 0

    def add(self, signs: np.ndarray) -> None:
        """Of one part; they come in the order of the contexts."""
        self.signs[:, self.filled:self.filled + signs.shape[1]] = signs
        self.filled += signs.shape[1]

    def vectors(self, size: int) -> np.ndarray:
        """All words' vectors, those of the seeds side by side. Signs are kept as bytes, a row a
        context, and become doubles only beside the weights that they meet."""
        blocks = math.ceil(size / SIGN_BITS)
        seeds = len(self.signs) // blocks
        signs = np.empty((seeds * size, self.signs.shape[1]), np.int8)
        for j in range(len(signs)):
            bits = self.signs[j // size * blocks + j % size // SIGN_BITS]
            signs[j] = 2 * (bits >> j % size % SIGN_BITS & 1) - 1
        signs = np.ascontiguousarray(signs.T)
        out = np.zeros((len(self.starts) - 1, seeds * size))
        for word in range(len(out)):
            for first in range(self.starts[word], self.starts[word + 1], _MET):
                pairs = slice(first, min(first + _MET, self.starts[word + 1]))
                out[word] += self.weight[pairs] @ signs.take(self.at[pairs], axis=0).astype(np.float64)
        out /= math.sqrt(size)
        return out


def dense_vectors(near: Company, seeds: Sequence[int] = tuple(fv.SEEDS),
                  vector_size: int = TrainingConfig.vector_size) -> DataFrame:
    """group, seed, word, n, vector: of all words in ``near``; those without pairs have zeros."""
    blocks = math.ceil(vector_size / SIGN_BITS)
    planes = len(seeds) * blocks
    unit = ["group", "part"]
    signs = [sign_bits(F.lit(s), F.col("word"), b) for s in seeds for b in range(blocks)]
    by_place = F.array_sort(F.collect_list(F.struct(
        "place", "word", "n", *[c.alias(f"s{k}") for k, c in enumerate(signs)])))
    named = near.vocabulary.groupBy(*unit).agg(by_place.alias("m")).select(
        *unit, F.col("m.word").alias("words"), F.col("m.n").alias("n"),
        F.concat(*[F.col(f"m.s{k}") for k in range(planes)]).alias("signs"))
    sent = _sent_signs(near.parts.select(*unit, "dests", "places").join(
        named.select(*unit, "signs"), unit), planes)

    def result(key: tuple, part: _Part) -> Iterator[pa.RecordBatch]:
        whole = part.vectors(vector_size)
        for k, seed in enumerate(seeds):
            for first in range(0, len(whole), _GIVEN):
                made = whole[first:first + _GIVEN, k * vector_size:(k + 1) * vector_size]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, made.size + 1, vector_size, dtype=np.int32)), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key[0]] * len(made)), pa.array([seed] * len(made), pa.int32()),
                     part.words.slice(first, len(made)), part.n.slice(first, len(made)), lists],
                    ["group", "seed", "word", "n", "vector"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part = None, None
        for at, rows in by_unit(batches, ("group", "part")):
            for k in range(len(rows)):
                if rows["source"][k].as_py() < 0:  # a part's own row comes first
                    if part is not None:
                        yield from result(key, part)
                    key, part = at, _Part({c: rows[c][k].as_py() for c in rows.schema.names}, planes)
                else:
                    part.add(np.frombuffer(rows["signs"][k].as_buffer(), np.int64).reshape(planes, -1))
        if part is not None:
            yield from result(key, part)

    own = near.parts.select(*unit, "total", "near", "ctx_near", "pairs").join(
        named.select(*unit, "words", "n"), unit).withColumn("source", F.lit(-1))
    rows = own.unionByName(sent, allowMissingColumns=True)
    return near.in_parts(rows, "source").mapInArrow(
        run, "group string, seed int, word string, n long, vector array<double>")
