"""Vector arithmetic as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def dot(a: Column | str, b: Column | str) -> Column:
    """The sum of products over the shorter length; null if a vector is null."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(n > 0, F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)).when(n == 0, 0.0)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalise(a: Column | str) -> Column:
    """The vector divided by its length; the zero vector as it is."""
    length = norm(a)
    return F.transform(a, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))
