"""Expressions on vector columns (ARRAY<DOUBLE>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitchframe.schemas import VECTOR_WIDTH


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalise(v: Column | str) -> Column:
    """v / max(|v|, 1e-12); a zero vector stays zero. The length is repeated beside v, so it is computed once."""
    length = F.greatest(norm(v), F.lit(1e-12))
    return F.zip_with(v, F.array_repeat(length, F.size(v)), lambda x, n: x / n)


def fit_width(v: Column | str, width: int = VECTOR_WIDTH) -> Column:
    """Cut or zero-pad to `width` numbers."""
    return F.slice(F.concat(_col(v), F.array_repeat(F.lit(0.0), width)), 1, width)


def zero_fill(c: Column | str) -> Column:
    """NULL or NaN -> 0."""
    return F.coalesce(F.nanvl(_col(c), F.lit(None).cast("double")), F.lit(0.0))
