"""How ratings spread over users and films."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspark.functions.ordering import order_key
from reelspark.functions.ranking import SLICE_ROWS, hot_of, rank_all, salted_join

PERCENTS = list(range(0, 100, 5))


def totals(ratings: DataFrame) -> DataFrame:
    return ratings.agg(
        F.count(F.lit(1)).alias("ratings"),
        F.countDistinct("userId").alias("users"),
        F.countDistinct("movieId").alias("films"),
    )


def profile_sizes(ratings: DataFrame, key: str, name: str = "n") -> DataFrame:
    return ratings.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def _with_film_sizes(ratings: DataFrame, name: str, min_rows: int) -> DataFrame:
    films = profile_sizes(ratings, "movieId", name)
    hot = hot_of(films, "movieId", name, min_rows)
    return salted_join(ratings, films, "movieId", "userId", hot)


def with_profile_sizes(ratings: DataFrame, min_rows: int = SLICE_ROWS) -> DataFrame:
    """Every rating with the number of ratings of its user and of its film.

    Counts are combined map-side and joined back, the rows of a popular film
    over several tasks; a window would sort them all in one.
    """
    sized = _with_film_sizes(ratings, "num_ratings_movie", min_rows)
    users = profile_sizes(ratings, "userId", "num_ratings_user")
    hot = hot_of(users, "userId", "num_ratings_user", min_rows)
    return salted_join(sized, users, "userId", "movieId", hot)


def describe(values: DataFrame, col: str = "n") -> DataFrame:
    """(statistic, value): count, mean, std, min, exact percentiles, max.

    Exact percentiles keep one counter per distinct value; profile sizes over N
    ratings have fewer than sqrt(2N) of those.
    """
    probs = F.array(*[F.lit(p / 100) for p in PERCENTS])
    wide = values.agg(
        F.count(col).cast("double").alias("count"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("std"),
        F.min(col).cast("double").alias("min"),
        F.percentile(col, probs).alias("p"),
        F.max(col).cast("double").alias("max"),
    )
    rows = [F.struct(F.lit(s).alias("statistic"), F.col(s).alias("value"))
            for s in ("count", "mean", "std", "min", "max")]
    rows += [F.struct(F.lit(f"{p}%").alias("statistic"), F.get("p", F.lit(i)).alias("value"))
             for i, p in enumerate(PERCENTS)]
    return wide.select(F.inline(F.array(*rows)))


def describe_profiles(ratings: DataFrame, key: str) -> DataFrame:
    return describe(profile_sizes(ratings, key))


def unique_counts(ratings: DataFrame) -> DataFrame:
    """(userId, unique_films): how many films nobody else has rated, 0 included."""
    alone = (
        ratings.groupBy("movieId")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("userId").alias("userId"))
        .filter(F.col("_n") == 1)
        .groupBy("userId")
        .agg(F.count(F.lit(1)).alias("unique_films"))
    )
    users = ratings.select("userId").distinct()
    return users.join(alone, "userId", "left").fillna(0, ["unique_films"])


def unique_share(counts: DataFrame) -> DataFrame:
    """One row: users, users with a film only they rated, and their share."""
    with_any = F.count_if(F.col("unique_films") > 0)
    return counts.agg(
        F.count(F.lit(1)).alias("users"),
        with_any.alias("users_with_unique"),
        F.try_divide(with_any, F.count(F.lit(1))).alias("share"),
    )


def unique_raters(ratings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts per user, share of users with any, description of the positive
    counts)."""
    counts = unique_counts(ratings)
    positive = counts.filter(F.col("unique_films") > 0)
    return counts, unique_share(counts), describe(positive, "unique_films")


def histogram(
    values: DataFrame, col: str, bins: int = 50, lo: float = 1, hi: float = 100
) -> DataFrame:
    """(bin, left, right, n): ``bins`` equal bins between the least and greatest
    value within [lo, hi]; the last bin is closed. Empty bins have n = 0."""
    inside = values.filter(F.col(col).between(lo, hi)).select(F.col(col).cast("double").alias("x"))
    least = inside.agg(F.min("x")).scalar()
    most = inside.agg(F.max("x")).scalar()
    # A single value gets a unit-wide range around it.
    half = F.when(least == most, F.lit(0.5)).otherwise(F.lit(0.0))
    start, span = least - half, (most + half) - (least - half)
    at = F.floor((F.col("x") - start) * F.lit(bins) / span) + 1
    counted = (
        inside.select(F.least(F.lit(bins), at).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    spark = values.sparkSession
    edges = spark.range(1, bins + 1).select(
        F.col("id").cast("int").alias("bin"),
        (start + span * (F.col("id") - 1) / F.lit(bins)).alias("left"),
        (start + span * F.col("id") / F.lit(bins)).alias("right"),
    )
    return edges.join(F.broadcast(counted), "bin", "left").fillna(0, ["n"])  # ``bins`` rows


def popularity_by_user(ratings: DataFrame, min_rows: int = SLICE_ROWS) -> DataFrame:
    """Per user: own number of ratings, mean and sample deviation of the number
    of ratings of the films they rated (null with one film)."""
    return _with_film_sizes(ratings, "_n", min_rows).groupBy("userId").agg(
        F.count(F.lit(1)).cast("double").alias("num_ratings_user_mean"),
        F.avg("_n").alias("num_ratings_movie_mean"),
        F.stddev_samp("_n").alias("num_ratings_movie_std"),
    )


def choose_samples(ratings: DataFrame, samples: Sequence[tuple[int, int]]) -> DataFrame:
    """(sample, userId): for the i-th (n, seed) of ``samples``, ``n`` users without replacement.

    A sample is the users with the smallest keys of its seed. All are taken in
    one pass: a task hands on no more users of a sample than the sample needs,
    and those are merged. Samples of more than ``SLICE_ROWS`` users are ranked
    in slices instead; the users are the same.
    """
    users = ratings.select("userId").distinct()
    most = max((n for n, _ in samples), default=0)
    keys = [F.struct(F.lit(i).alias("sample"), order_key(seed, F.col("userId")).alias("_key"))
            for i, (_, seed) in enumerate(samples)]
    if most > SLICE_ROWS:
        ranked = [rank_all(users.withColumn("_key", order_key(seed, F.col("userId"))), "_key", "userId", "_rn").filter(
            F.col("_rn") <= n).select(F.lit(i).alias("sample"), "userId") for i, (n, seed) in enumerate(samples)]
        return reduce(DataFrame.unionByName, ranked)
    keyed = users.select("userId", F.inline(F.array(*keys)))
    order = W.partitionBy("sample").orderBy("_key", "userId")
    sizes = F.array(*[F.lit(n) for n, _ in samples])
    return keyed.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= most).filter(
        F.col("_rn") <= F.get(sizes, F.col("sample"))).select("sample", "userId")


def choose_users(ratings: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` users without replacement: (userId)."""
    return choose_samples(ratings, [(n, seed)]).select("userId")


def sample_users(ratings: DataFrame, n: int, seed: int = 9) -> DataFrame:
    """All ratings of ``n`` users with the counts inside the sample, in key order."""
    kept = ratings.join(choose_users(ratings, n, seed), "userId", "left_semi")
    return with_profile_sizes(kept).orderBy("userId", "movieId")


def top_raters(ratings: DataFrame, value: float = 5.0) -> DataFrame:
    """(userId, n): ratings equal to ``value`` per user, most first."""
    return (
        ratings.filter(F.col("rating") == F.lit(value))
        .groupBy("userId")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "userId")
    )
