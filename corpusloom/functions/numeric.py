"""Numeric functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, at least 0; 0 where one is missing or null, lengths differ or a norm is 0."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (na > 0) & (nb > 0)
    return F.when(ok, F.greatest(F.lit(0.0), dot(a, b) / (na * nb))).otherwise(0.0)


def money(x: Column) -> Column:
    """Six places, half up."""
    return F.round(x.cast("decimal(24,12)"), 6).cast("decimal(18,6)")


def parse_date(x: Column, *formats: str) -> Column:
    return F.coalesce(*(F.try_to_date(x, f) for f in formats))
