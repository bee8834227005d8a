"""Vector arithmetic on array columns, in double."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(0.0)


def unit(a: Column) -> Column:
    """Scaled to length one; a zero vector stays as it is."""
    n = norm(a)
    # the one-row array holds the norm, so that it is computed once and not for each element
    held = F.array(F.struct(a.alias("v"), F.when(n > 0, n).otherwise(1.0).alias("n")))
    return F.get(F.transform(held, lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["n"])), F.lit(0))


def l2_similarity(a: Column, b: Column) -> Column:
    """1 - squared Euclidean distance, the similarity of the default metric."""
    return 1.0 - F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def recency_score(
    similarity: Column, age_days: Column, halflife: float = 540.0, weight: float = 0.25
) -> Column:
    age = F.greatest(F.lit(0.0), age_days)
    return similarity * (1.0 + F.lit(weight) * F.pow(F.lit(0.5), age / halflife))
