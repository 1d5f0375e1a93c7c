"""Expressions over dense vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def unit(vector: Column) -> Column:
    """The vector scaled to length one; the zero vector is returned as it is."""
    # the norm is computed once per row and carried into the lambda through an array
    length = F.array(norm(vector))
    scaled = F.flatten(
        F.transform(
            length,
            lambda n: F.transform(
                vector, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))
            ),
        )
    )
    return scaled


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity, 0.0 when either side has no length."""
    lengths = norm(left) * norm(right)
    return F.when(lengths > 0, dot(left, right) / lengths).otherwise(F.lit(0.0))
