"""Vector expressions on ``array<float|double>`` columns and on lists of columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(components: Sequence[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [c * c for c in components]))


def dot_columns(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x + y, [p * q for p, q in zip(a, b)])


def dot(a: Column, b: Column) -> Column:
    """Dot product of two array columns, accumulated in double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def array_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when a norm is zero."""
    scale = array_norm(a) * array_norm(b)
    return F.when(scale > 0, dot(a, b) / scale)


def l2_normalise(v: Column, floor: float = 1e-9) -> Column:
    """Scale to unit length; vectors shorter than ``floor`` are left as they are."""
    length = array_norm(v)
    divisor = F.when(length < floor, F.lit(1.0)).otherwise(length)
    return F.transform(v, lambda x: x.cast("double") / divisor)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common lower-cased distinct entries; 0 when both are empty."""
    x = F.array_distinct(F.transform(F.array_compact(a), F.lower))
    y = F.array_distinct(F.transform(F.array_compact(b), F.lower))
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))
