"""Name -> query and name -> SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def r6(c: str | Column) -> Column:
    """Six decimals, so that the order of floating-point sums does not show."""
    return F.round(F.col(c).cast("double") if isinstance(c, str) else c, 6)


def flat(factors: DataFrame, key: str = "id", digits: int = 6) -> DataFrame:
    """(key, pos, value): one row per vector element."""
    return factors.select(key, F.posexplode("features").alias("pos", "v")).select(
        key,
        (F.col("pos") + 1).cast("bigint").alias("pos"),
        F.round(F.col("v").cast("double"), digits).alias("value"),
    )
