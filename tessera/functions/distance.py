"""Vector distances as JVM-side expressions, in double precision."""

from __future__ import annotations

import enum
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


class Metric(enum.Enum):
    COSINE = "cosine"
    EUCLIDEAN = "euclidean"  # squared, without the root
    DOT = "dot"  # negated, so that less is nearer


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0).cast("double"), lambda a, b: a + b)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / size)


def euclidean_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def dot_distance(a: Column, b: Column) -> Column:
    return -dot(a, b)


def distance(metric: Metric, a: Column, b: Column) -> Column:
    return {Metric.COSINE: cosine_distance, Metric.EUCLIDEAN: euclidean_distance, Metric.DOT: dot_distance}[metric](a, b)


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))
