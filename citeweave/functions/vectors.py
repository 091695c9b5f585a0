"""Vector columns: arrays of numbers, arithmetic in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def finite(v: Column) -> Column:
    """Whether each component is a finite number; false for null vectors and components."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _scaled(v: Column, least: float, below: Column | None) -> Column:
    """v divided by its norm, which is computed once; where that is below `least`, by `least` or, if given, `below`."""
    held = F.array(F.struct(v.alias("v"), norm(v).alias("n")))  # one element, so that the norm is not computed per component
    by = lambda s: F.greatest(s["n"], F.lit(least)) if below is None else s["n"]
    one = lambda s, x: x / by(s) if below is None else F.when(s["n"] < least, below).otherwise(x / by(s))
    return F.get(F.transform(held, lambda s: F.transform(s["v"], lambda x: one(s, x))), 0)


def unit(v: Column) -> Column:
    """v with non-finite components 0, divided by its norm; all zero where that is below 1e-12; null for a null vector."""
    clean = F.transform(doubles(v), lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x))
    return _scaled(clean, 1e-12, F.lit(0.0))


def truncated(v: Column, dim: int) -> Column:
    """The first dim components brought to unit length; v itself where dim is not above 0 or not below its size."""
    if dim <= 0:
        return doubles(v)
    return F.when(F.size(v) <= dim, doubles(v)).otherwise(_scaled(F.slice(doubles(v), 1, dim), 1e-12, None))
