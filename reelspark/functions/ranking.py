"""Joins and row numbers that never bring one large group to one task.

Large groups are found by counting and cut into slices. For row numbers the
slices follow the order: ``order_key`` values are spread evenly over
[0, MODULUS), so slicing that range cuts a group evenly; rows are numbered
inside each slice and the sizes of the slices before it are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspark.functions.ordering import MODULUS

SLICE_ROWS = 100_000
#: Keys that are listed as hot at most, whatever the session's number of partitions.
LISTED_KEYS = 10_000


def hot_of(sizes: DataFrame, key: str, rows: str, min_rows: int = SLICE_ROWS) -> DataFrame:
    """The keys that need splitting, from their counts: (key, hot_rows, hot_slices).

    A key is hot if it has more than ``min_rows`` rows and more than its part of
    the table: one in ``LISTED_KEYS``, or one in four times the shuffle
    partitions if those are more. So there are fewer hot keys than such parts,
    which makes the list safe to broadcast, and none is left out.
    """
    partitions = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(LISTED_KEYS, 4 * partitions)
    share = sizes.agg(F.coalesce(F.sum(rows), F.lit(0)) / F.lit(parts)).scalar()
    return (
        sizes.filter(F.col(rows) > F.lit(min_rows)).filter(F.col(rows) > share)
        .select(key, F.col(rows).alias("hot_rows"),
                F.ceil(F.col(rows) / F.lit(min_rows)).alias("hot_slices"))
    )


def hot_keys(df: DataFrame, key: str, min_rows: int = SLICE_ROWS) -> DataFrame:
    """``hot_of`` the rows of ``df``; counts are combined map-side."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    return hot_of(sizes, key, "_rows", min_rows)


def salted_join(
    fact: DataFrame, dim: DataFrame, key: str, spread: str, hot: DataFrame, how: str = "inner"
) -> DataFrame:
    """``fact`` joined with ``dim``, which has one row per key.

    The rows of a hot key are spread by a hash of the column ``spread`` and meet
    a copy of the key's row in each place. Adaptive execution splits skewed
    joins by itself, but not where one side is an aggregate by the same key,
    which is the case this is for.
    """
    slices = F.broadcast(hot.select(key, "hot_slices"))  # bounded, see hot_of
    at = F.pmod(F.xxhash64(spread), F.col("hot_slices"))
    salted = fact.join(slices, key, "left").withColumn("_salt", F.coalesce(at, F.lit(0)))
    every = F.sequence(F.lit(0).cast("bigint"), F.coalesce("hot_slices", F.lit(1)) - 1)
    copies = (
        dim.join(slices, key, "left").withColumn("_salt", F.explode(every)).drop("hot_slices")
    )
    return salted.join(copies, [key, "_salt"], how).drop("_salt", "hot_slices")


def rank_in_group(
    df: DataFrame,
    group: str,
    key: str,
    tie: str,
    number: str = "rn",
    size: str = "profile_size",
    min_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add the 1-based position by (``key``, ``tie``) within ``group`` and the
    group's size. ``key`` is an ``order_key`` column.

    Groups up to ``min_rows`` are one slice and cost one shuffle. Larger ones
    are spread over several tasks.
    """
    hot = F.broadcast(hot_keys(df, group, min_rows))  # bounded, see hot_of
    slice_of = F.floor(F.col(key) * F.coalesce("hot_slices", F.lit(1)) / F.lit(MODULUS))
    sliced = df.join(hot, group, "left").withColumn("_slice", slice_of)

    # One row per slice of a hot group: its offset. The window is over the
    # slices of one group, not over its rows.
    before = W.partitionBy(group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        sliced.filter(F.col("hot_slices").isNotNull())
        .groupBy(group, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )

    part = W.partitionBy(group, "_slice")
    numbered = (
        sliced.repartition(group, "_slice")
        .withColumn("_local", F.row_number().over(part.orderBy(key, tie)))
        .withColumn("_slice_rows", F.count(F.lit(1)).over(part))
    )
    return (
        numbered.join(offsets, [group, "_slice"], "left")
        .withColumn(number, (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("bigint"))
        .withColumn(size, F.coalesce("hot_rows", "_slice_rows").cast("bigint"))
        .drop("_local", "_slice", "_slice_rows", "_before", "hot_rows", "hot_slices")
    )


def rank_all(df: DataFrame, key: str, tie: str, number: str = "rn") -> DataFrame:
    """Add the 1-based position by (``key``, ``tie``) over the whole frame.

    The frame is cut into even slices of about ``SLICE_ROWS`` rows; only the
    table of slice sizes (one row each) passes through one task.
    """
    slices = df.agg(F.ceil(F.count(F.lit(1)) / F.lit(SLICE_ROWS)) + 8).scalar()
    slice_of = F.floor(F.col(key) * slices / F.lit(MODULUS))
    sliced = df.withColumn("_slice", slice_of)
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy("_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    local = F.row_number().over(W.partitionBy("_slice").orderBy(key, tie))
    return (
        sliced.withColumn("_local", local)
        .join(offsets, "_slice")  # one row per slice; broadcast by Spark if small
        .withColumn(number, (F.col("_local") + F.col("_before")).cast("bigint"))
        .drop("_slice", "_local", "_before")
    )
