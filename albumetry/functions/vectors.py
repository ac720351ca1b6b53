"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def pair_probability(positive: Column, negative: Column, tau: float) -> Column:
    """Softmax share of the positive of two similarities."""
    return logistic((positive - negative) / F.lit(tau))
