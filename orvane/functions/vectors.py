"""Vector arithmetic as column expressions, in double precision.

A sum over an array is a left fold, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLES = "array<double>"


def doubles(v: Column) -> Column:
    return v.cast(DOUBLES)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Dot product; vectors of different lengths raise an error."""
    a, b = doubles(a), doubles(b)
    ok = F.assert_true(F.size(a) == F.size(b), F.lit("vectors differ in length"))
    return F.when(ok.isNull(), _sum(F.zip_with(a, b, lambda x, y: x * y)))


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector raises an error."""
    size = norm(a) * norm(b)
    return F.when(size > 0, _dot(a, b) / size).otherwise(F.raise_error(F.lit("cosine of a zero vector")).cast("double"))


def score(metric: str, a: Column, b: Column, a_norm: Column | None = None, b_norm: Column | None = None) -> Column:
    """Similarity for search; admission has ruled out bad vectors.  Known norms are used."""
    if metric == "dot":
        return _dot(a, b)
    return _dot(a, b) / ((norm(a) if a_norm is None else a_norm) * (norm(b) if b_norm is None else b_norm))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def normalized(v: Column) -> Column:
    """The vector divided by its norm; a zero vector raises an error."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(F.raise_error(F.lit("cannot normalise a zero vector")).cast(DOUBLES))


def routing_distance(routing: str, query: Column, centroid: Column) -> Column:
    """Distance that orders lists: 1 - cosine, -dot, or squared euclidean."""
    if routing == "cosine":
        return 1 - score("cosine", query, centroid)
    return -_dot(query, centroid) if routing == "dot" else squared_distance(query, centroid)


def admissible(v: Column, dim: int, metric: str) -> Column:
    """Whether a vector may enter a collection: exact width, finite, within single precision, not all zero for cosine."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) <= 3.4028234663852886e38))
    ok = v.isNotNull() & (F.size(v) == dim) & fine
    return F.coalesce(ok & F.exists(v, lambda x: x.cast("float") != 0) if metric == "cosine" else ok, F.lit(False))
