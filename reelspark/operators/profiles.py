"""Profiles of users the model has never seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions.ordering import order_key
from reelspark.functions.ranking import SLICE_ROWS, rank_all, rank_in_group


def build_profiles(ratings: DataFrame, seed: int = 9, min_rows: int = SLICE_ROWS) -> DataFrame:
    """(userId, movieId, rating, rn, profile_size) with each user's ratings in a
    random order fixed by ``seed``."""
    key = order_key(seed, F.col("userId"), F.col("movieId"))
    keyed = ratings.select("userId", "movieId", "rating").withColumn("_key", key)
    return rank_in_group(keyed, "userId", "_key", "movieId", min_rows=min_rows).select(
        "userId", "movieId", "rating", "rn", "profile_size"
    )


def filter_obscure(
    profiles: DataFrame, train_items: DataFrame, most: int = 20
) -> tuple[DataFrame, DataFrame]:
    """(profiles kept, ids of the users dropped).

    A user is dropped when too much of the profile is films the model was not
    trained on. ``train_items`` is a table of movieId; both this and
    ``split_profiles`` only test membership in it.
    """
    size, unknown = F.col("profile_size"), F.col("profile_size") - F.coalesce("known", F.lit(0))
    too_many = F.when(size >= 40, unknown >= size - F.lit(5 * most / 4)).otherwise(
        unknown >= F.floor(size * 3 / 8)
    )
    known = (
        profiles.join(train_items.select("movieId"), "movieId", "left_semi")
        .groupBy("userId")
        .agg(F.count(F.lit(1)).alias("known"))
    )
    users = (
        profiles.filter(F.col("rn") == 1)
        .select("userId", "profile_size")
        .join(known, "userId", "left")
        .select("userId", too_many.alias("obscure"))
    )
    dropped = users.filter("obscure").select("userId")
    kept = users.filter(~F.col("obscure")).select("userId")
    return profiles.join(kept, "userId", "left_semi"), dropped


def split_profiles(
    profiles: DataFrame, train_items: DataFrame, most: int = 20
) -> tuple[DataFrame, DataFrame]:
    """(train, validation): the first half of a profile, at most ``most`` rows,
    and the known films among the rest."""
    train_size = F.least(F.ceil(F.col("profile_size") / 2), F.lit(most))
    columns = ["userId", "movieId", "rating", "rn", "profile_size"]
    train = profiles.filter(F.col("rn") <= train_size)
    rest = profiles.filter(F.col("rn") > train_size)
    validation = rest.join(train_items.select("movieId"), "movieId", "left_semi")
    return train.select(*columns), validation.select(*columns)


def user_folds(ratings: DataFrame, folds: int = 3, seed: int = 9) -> DataFrame:
    """(userId, fold): ``folds`` random groups of equal size; the users left over
    have a null fold and are never tested."""
    users = ratings.select("userId").distinct()
    size = users.agg(F.floor(F.count(F.lit(1)) / F.lit(folds))).scalar()
    keyed = users.withColumn("_key", order_key(seed, F.col("userId")))
    at = F.floor(F.try_divide(F.col("_rn") - 1, size))
    return rank_all(keyed, "_key", "userId", "_rn").select(
        "userId", F.when(at < folds, at).cast("int").alias("fold")
    )
