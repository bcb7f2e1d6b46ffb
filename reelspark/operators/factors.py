"""Algebra on factor and prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions.vectors import mean_vector
from reelspark.operators.catalogue import override_rows


def average_factors(proposed: DataFrame, rank: int) -> DataFrame:
    """Element-wise mean of the vectors proposed for each id."""
    mean = mean_vector(F.col("features"), rank).cast("array<float>")
    return proposed.groupBy("id").agg(mean.alias("features"))


def merge_factors(old: DataFrame, new: DataFrame) -> DataFrame:
    """New vector where there is one, else the old."""
    fresh = new.select("id", "features").filter(F.col("features").isNotNull())
    return override_rows(old.select("id", "features"), fresh, "id")


def merge_predictions(old: DataFrame, new: DataFrame) -> DataFrame:
    """New prediction where there is one, else the old; keys (userId, movieId)."""
    fresh = new.filter(F.col("predictedRating").isNotNull())
    return override_rows(old, fresh, ["userId", "movieId"])
