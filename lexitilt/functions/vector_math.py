"""Dense vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a norm is 0."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, 0.0).otherwise(dot(a, b) / lengths)


def sum_of_vectors(vector: Column, size: int, weight: Column | None = None) -> Column:
    """Aggregate: element-wise sum of array columns of one size."""
    def element(i: int) -> Column:
        value = F.get(vector, F.lit(i))
        return value if weight is None else value * weight
    return F.array(*[F.sum(element(i)) for i in range(size)])
