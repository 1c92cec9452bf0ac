"""Distances of dense vectors as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity, at least 0; null if a vector is null or zero."""
    d = 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(d.isNotNull(), F.greatest(F.lit(0.0), d))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


METRICS = {"cosine": cosine_distance, "euclidean": euclidean_distance}


def distance(metric: str, a: Column, b: Column) -> Column:
    if metric not in METRICS:
        raise NotImplementedError(f"unknown distance: {metric}")
    return METRICS[metric](a, b)
