"""Vector expressions that stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column, rank: int | None = None) -> Column:
    """Inner product in double precision.

    With a known ``rank`` the sum is written out, which compiles to straight
    code; ``aggregate`` over ``zip_with`` is interpreted per element.
    """
    if rank is not None and rank <= 64:
        terms = [
            F.get(a, F.lit(i)).cast("double") * F.get(b, F.lit(i)).cast("double")
            for i in range(rank)
        ]
        return reduce(lambda x, y: x + y, terms)
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def scale(v: Column, by: Column, to: str = "float") -> Column:
    """Every element times ``by``."""
    return F.transform(v, lambda x: (x.cast("double") * by).cast(to))


def mean_vector(v: Column, rank: int) -> Column:
    """Element-wise mean as an aggregate: ``rank`` averages, combined map-side."""
    return F.array(*[F.avg(F.get(v, F.lit(i)).cast("double")) for i in range(rank)])
