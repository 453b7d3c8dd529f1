"""Dense vectors in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v) -> Column:
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v, floor: float = 1e-8) -> Column:
    n = F.greatest(norm(v), F.lit(floor))
    return F.transform(as_double(v), lambda x: x / n)


def cosine_distance(a, b) -> Column:
    """1 - a.b, for unit vectors."""
    return F.lit(1.0) - dot(a, b)


def appearance(learned, color) -> Column:
    """The unit vector of .7 learned and 1.15 colour components, one after the other."""
    return normalized(F.concat(F.transform(as_double(learned), lambda x: x * 0.7), F.transform(as_double(color), lambda x: x * 1.15)))
