"""The words nearest to a few query words in whole vocabularies, worked out by parts.

What ``vectors.neighbours`` finds in ``vectors.ppmi_vectors`` without a word list, but from the pairs
that ``company`` keeps by parts. A query's row is sent once to each part of its group, as one packed
row; there it meets the part's pairs, so no cell crosses a shuffle or is written as a row, and a part
passes on its own ``k`` nearest only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexitilt.functions import fixed_values as fv
from lexitilt.operators.company import Company, by_unit, unpack

_ROW = "group string, query string, source int, norm double, numbers binary, weights binary"


def _weights(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a part's pairs: the word's place, the index of the context, the mutual information."""
    near, ctx_near = np.frombuffer(row["near"]), np.frombuffer(row["ctx_near"])
    keys, n = unpack(row["pairs"])
    place, at = keys >> 32, keys & 0xFFFFFFFF
    return place, at, np.log(n * row["total"] / (near[place] * ctx_near[at]))


def _query_rows(near: Company, queries: Sequence[str]) -> DataFrame:
    """group, query, source (the query's number), norm, numbers (of its contexts), weights."""
    order = list(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                place, at, weight = _weights(row)
                contexts = np.frombuffer(row["contexts"], np.int64)
                for own, word in zip(row["places"], row["words"]):
                    mine = slice(*np.searchsorted(place, [own, own + 1]))
                    if mine.start < mine.stop:  # else a word without cells
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row["group"]]), pa.array([word]), pa.array([order.index(word)], pa.int32()),
                             pa.array([float(np.sqrt((weight[mine] ** 2).sum()))]),
                             pa.array([contexts[at[mine]].tobytes()]), pa.array([weight[mine].tobytes()])],
                            ["group", "query", "source", "norm", "numbers", "weights"])

    asked = (near.vocabulary.filter(F.col("word").isin(order)).groupBy("group", "part")
             .agg(F.collect_list(F.struct("place", "word")).alias("w"))
             .select("group", "part", F.col("w.place").alias("places"), F.col("w.word").alias("words")))
    rows = near.parts.select("group", "part", "total", "near", "contexts", "ctx_near", "pairs")
    return rows.join(asked, ["group", "part"]).mapInArrow(run, _ROW)


def neighbours(near: Company, queries: Sequence[str] = tuple(fv.NEIGHBOUR_WORDS), k: int = 10) -> DataFrame:
    """group, query, rank, word, similarity: the k words nearest to each query word by cosine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, rows in by_unit(batches, ("group", "part")):
            for row in rows.to_pylist():
                if row["source"] < 0:  # a part's own row comes first
                    place, met, weight = _weights(row)
                    contexts = np.frombuffer(row["contexts"], np.int64)
                    norms = np.sqrt(np.bincount(place, weight ** 2, len(row["near"]) // 8))
                    continue
                mine = np.zeros(len(contexts))
                numbers = np.frombuffer(row["numbers"], np.int64)
                here = np.minimum(np.searchsorted(contexts, numbers), max(len(contexts) - 1, 0))
                if len(contexts):
                    known = contexts[here] == numbers
                    mine[here[known]] = np.frombuffer(row["weights"])[known]
                dots = np.bincount(place, weight * mine[met], len(norms))
                other = np.flatnonzero(norms > 0)
                scores = np.round(dots[other] / norms[other], 9)
                first = np.lexsort((other, -scores))[:k + 1]  # the query may be among them
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at[0]] * len(first)), pa.array([at[1]] * len(first), pa.int32()),
                     pa.array(other[first]), pa.array([row["query"]] * len(first)),
                     pa.array(scores[first]), pa.array([row["norm"]] * len(first))],
                    ["group", "part", "place", "query", "score", "norm"])

    own = near.parts.select("group", "part", F.lit(-1).alias("source"), "total", "near", "contexts", "ctx_near", "pairs")
    sent = _query_rows(near, queries).join(near.parts.select("group", "part"), "group")
    found = near.in_parts(own.unionByName(sent, allowMissingColumns=True), "source").mapInArrow(
        run, "group string, part int, place long, query string, score double, norm double")
    names = near.vocabulary.select("group", "part", F.col("place").cast("long").alias("place"), "word")
    order = W.partitionBy("group", "query").orderBy(F.desc("score"), "word")
    return (found.join(names, ["group", "part", "place"]).filter(F.col("word") != F.col("query"))
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("group", "query", "rank", "word", (F.col("score") / F.col("norm")).alias("similarity")))
