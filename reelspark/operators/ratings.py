"""Keeping the ratings table current."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions.ranking import SLICE_ROWS, hot_of, salted_join
from reelspark.operators.catalogue import override_rows

KEY = ["userId", "movieId"]


def latest(batch: DataFrame) -> DataFrame:
    """One row per (userId, movieId). With a ``seq`` column the highest wins;
    without one rows of a key cannot be ordered and the highest rating wins."""
    order = F.struct("seq", "rating") if "seq" in batch.columns else F.struct("rating")
    return batch.groupBy(*KEY).agg(F.max(order)["rating"].alias("rating"))


def upsert_ratings(ratings: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch's rating where there is one, else the old. A row keeps its
    ``full_train`` flag when overwritten; a new row has none.

    ``ratings`` is only filtered by the batch's keys, so it is not shuffled for
    a batch small enough to broadcast.
    """
    fresh = latest(batch.filter(F.col("rating").isNotNull()))
    rating = F.col("rating").cast(ratings.schema["rating"].dataType)
    fresh = fresh.withColumn("rating", rating)
    kept = [c for c in ratings.columns if c not in (*KEY, "rating")]
    if kept:
        flags = ratings.select(*KEY, *kept).join(fresh.select(*KEY), KEY, "left_semi")
        fresh = fresh.join(flags, KEY, "left")
    return override_rows(ratings, fresh, KEY).select(*ratings.columns)


def as_ownership(pairs: DataFrame, value: float = 4.0) -> DataFrame:
    """Owned films as ratings of ``value``."""
    return pairs.select(*KEY).distinct().withColumn("rating", F.lit(value).cast("float"))


def add_to_collection(ratings: DataFrame, pairs: DataFrame, value: float = 4.0) -> DataFrame:
    """Upsert owned films at the rating ownership stands for."""
    return upsert_ratings(ratings, as_ownership(pairs, value))


def remove_ratings(ratings: DataFrame, pairs: DataFrame) -> DataFrame:
    return ratings.join(pairs.select(*KEY), KEY, "left_anti")


def touched_rows(ratings: DataFrame, batch: DataFrame) -> DataFrame:
    """The ratings that share a user or a film with the batch."""
    of_users = ratings.join(batch.select("userId"), "userId", "left_semi")
    others = ratings.join(batch.select("userId"), "userId", "left_anti")
    return of_users.unionByName(others.join(batch.select("movieId"), "movieId", "left_semi"))


def _touched(
    ratings: DataFrame, batch: DataFrame, key: str, other: str, threshold: int, min_rows: int
) -> DataFrame:
    rows = ratings.join(batch.select(key), key, "left_semi")
    sizes = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count("full_train").alias("_trained"),  # nulls are rows not yet trained on
    )
    small = sizes.filter(F.col("_trained") <= threshold).select(key)
    hot = hot_of(sizes, key, "_rows", min_rows)
    return salted_join(rows, small, key, other, hot, "left_semi").select(*KEY, "rating")


def select_for_update(
    ratings: DataFrame, batch: DataFrame, threshold: int = 20, min_rows: int = SLICE_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(rows of the users, rows of the films) that the batch touches and whose
    trained profile has at most ``threshold`` rows."""
    return (
        _touched(ratings, batch, "userId", "movieId", threshold, min_rows),
        _touched(ratings, batch, "movieId", "userId", threshold, min_rows),
    )
