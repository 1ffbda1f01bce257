"""Vectors as arrays of doubles, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def same_length(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.lit(True)).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("boolean"))


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(same_length(a, b), F.sqrt(_sum(squares)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector is zero or lengths differ."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (length > 0), dot(a, b) / length)


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def pooled(a: Column, bins: int) -> Column:
    """Adaptive average pooling: bin i averages elements from floor(i n / bins) to ceil((i + 1) n / bins)."""
    n = F.size(a)

    def one(i: Column) -> Column:
        start = F.floor(i * n / bins).cast("int")
        stop = F.ceil((i + 1) * n / bins).cast("int")
        return _sum(F.transform(F.slice(a, start + 1, stop - start), lambda x: x.cast("double"))) / (stop - start)

    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), one)
