"""Similarities, distances and kernels of array columns, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    return F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def squared_euclidean(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 where a norm is 0."""
    return 1 - cosine_similarity(a, b)


def centered(v: Column) -> Column:
    return let(total(doubles(v)) / F.size(v), lambda m: F.transform(v, lambda x: x.cast("double") - m))


def pearson(a: Column, b: Column) -> Column:
    """0 where either side doesn't vary."""
    return cosine_similarity(centered(a), centered(b))


def rbf(a: Column, b: Column, gamma: float = 1.0) -> Column:
    return F.exp(-gamma * squared_euclidean(a, b))


def polynomial(a: Column, b: Column, degree: int = 3, coef0: float = 1.0) -> Column:
    return F.pow(dot(a, b) + coef0, F.lit(float(degree)))


def renyi_entropy(p: Column, q: float = 1.0) -> Column:
    """Of order q, in nats, of shares p: Shannon's for 1, -ln of the largest for infinity. Shares of 0 don't count."""
    some = F.filter(p, lambda x: x > 0)
    if q == 1:
        return -total(F.transform(some, lambda x: x * F.log(x)))
    if q == float("inf"):
        return -F.log(F.array_max(some))
    return F.log(total(F.transform(some, lambda x: F.pow(x, F.lit(float(q)))))) / (1 - q)


SIMILARITIES = {"cosine": cosine_similarity, "euclidean": lambda a, b: 1 / (1 + euclidean(a, b)), "manhattan": lambda a, b: 1 / (1 + manhattan(a, b)), "dot_product": dot, "pearson": pearson}
DISTANCES = {"euclidean": euclidean, "squared_euclidean": squared_euclidean, "manhattan": manhattan, "cosine": cosine_distance}
KERNELS = {"rbf": rbf, "polynomial": polynomial, "linear": dot}


def named(table: dict, name: str):
    if name not in table:
        raise ValueError(f"{name!r} is none of {sorted(table)}")
    return table[name]
