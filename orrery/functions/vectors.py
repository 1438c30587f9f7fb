"""Vector expressions as plain Columns (whole-stage code, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ABS = 1e16
TINY = 1e-10


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed from the left."""
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Unit length; zero vectors stay as they are."""
    n = norm(v)
    return F.when(n > 0, F.transform(as_doubles(v), lambda x: x / n)).otherwise(as_doubles(v))


def scaled(v: Column, by: Column) -> Column:
    return F.transform(as_doubles(v), lambda x: x * by)


def relevance_cosine(score: Column) -> Column:
    """(s + 1) / 2, clamped to [0, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score + 1) / 2))


def relevance_dot(score: Column) -> Column:
    """(s + 1) / 2, not clamped."""
    return (score + 1) / 2


def similarity_cosine(score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def similarity_inner(score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score + 1) / 2))


def scale_score(score: Column, cosine: bool) -> Column:
    """Dot: sigmoid(s / 100); cosine: (clamp(s, -1, 1) + 1) / 2."""
    if cosine:
        return (F.least(F.lit(1.0), F.greatest(F.lit(-1.0), score)) + 1) / 2
    return 1 / (1 + F.exp(-score / 100))


def bad_coordinate(v: Column) -> Column:
    """Position (from 0) of the first coordinate that isn't finite and below 1e16 in size; null if all are good."""
    flags = F.transform(as_doubles(v), lambda x: ~F.coalesce((F.abs(x) < MAX_ABS) & ~F.isnan(x), F.lit(False)))
    at = F.array_position(flags, True)
    return F.when(at > 0, at - 1).cast("int")
