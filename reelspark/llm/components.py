"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is its component's smallest node.

    Alternates two steps until every edge points at a root: in the first, all
    larger neighbours of a node are linked to its smallest neighbour; in the
    second, all smaller ones. Neither adds edges, and nothing is gathered by
    node: the smallest neighbour is an aggregate that is combined before the
    shuffle. Each round is written to the shared folder. Rows with a null and
    loops are ignored; an empty graph gives no rows.
    """
    a, b = F.col("a"), F.col("b")
    now = cut(
        edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.filter("u != v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = cut(
            small.select("u", F.col("m").alias("v"))
            .union(small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        before, state = state, _state(now)
        if before == state:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    """Number of edges and a sum over them, which tell whether a round changed any."""
    part = F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(part)).first())
