"""Column expressions over ARRAY vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def distance(a: Column, b: Column) -> Column:
    def squared(x, y):
        gap = x.cast("double") - y.cast("double")
        return gap * gap

    return F.sqrt(_total(F.zip_with(a, b, squared)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(0.0)


def mean_vector(col: str | Column) -> Column:
    """Aggregate: element-wise mean as ARRAY<DOUBLE>.

    One buffer of the vector's length per group and map task, so the shuffle
    carries partial means and not exploded elements.
    """
    col = F.col(col) if isinstance(col, str) else col
    return vector_to_array(Summarizer.mean(array_to_vector(col)))


def sum_vector(col: str | Column) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return vector_to_array(Summarizer.sum(array_to_vector(col)))
