"""Vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdoc.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def valid(v: Column) -> Column:
    """Not null, not empty, without null or NaN, and of positive length."""
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double"))) & (norm(v) > 0), F.lit(False))


def unit(v: Column) -> Column:
    """v / |v|; null where v isn't valid."""
    return F.when(valid(v), let(norm(v), lambda n: F.transform(v, lambda x: x.cast("double") / n)))


def distance(a: Column, b: Column, metric: str = "l2sq") -> Column:
    """l2sq (squared, as vector stores name l2), l2 or cosine."""
    if metric == "cosine":
        return 1 - dot(a, b) / (norm(a) * norm(b))
    squared = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    if metric not in ("l2sq", "l2"):
        raise ValueError(f"unknown metric {metric}")
    return squared if metric == "l2sq" else F.sqrt(squared)
