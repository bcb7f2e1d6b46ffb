"""Queries for the rating statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.operators import statistics as st
from workload import views as v
from workload.registry import query, r6


@query("e1_totals", v.with_views(["ratings"], {}, """
    SELECT COUNT(*) AS ratings, COUNT(DISTINCT userId) AS users, COUNT(DISTINCT movieId) AS films
    FROM ratings"""))
def e1_totals(spark, sf):
    return st.totals(v.ratings(spark, sf))


@query("e2_with_profile_sizes", v.with_views(["ratings"], {}, """
    SELECT userId, movieId, rating, COUNT(*) OVER (PARTITION BY userId) AS num_ratings_user,
           COUNT(*) OVER (PARTITION BY movieId) AS num_ratings_movie FROM ratings"""))
def e2_with_profile_sizes(spark, sf):
    return st.with_profile_sizes(v.ratings(spark, sf))


def _describe_sql(source: str, label: str) -> str:
    probs = ", ".join(f"{p / 100}" for p in st.PERCENTS)
    rows = [("count", "CAST(COUNT(n) AS DOUBLE)"), ("mean", "AVG(n)"), ("std", "STDDEV_SAMP(n)"),
            ("min", "CAST(MIN(n) AS DOUBLE)"), ("max", "CAST(MAX(n) AS DOUBLE)")]
    plain = [f"SELECT '{label}' AS key, '{s}' AS statistic, ROUND({e}, 6) AS value FROM {source}"
             for s, e in rows]
    names = ", ".join(f"'{p}%'" for p in st.PERCENTS)
    ranks = (f"SELECT '{label}', UNNEST([{names}]), "
             f"ROUND(UNNEST(quantile_cont(CAST(n AS DOUBLE), [{probs}])), 6) FROM {source}")
    return " UNION ALL ".join([*plain, ranks])


@query("e3_describe_profiles", v.with_views(["fine_ratings"], {
    "users": "SELECT COUNT(*) AS n FROM fine_ratings GROUP BY userId",
    "films": "SELECT COUNT(*) AS n FROM fine_ratings GROUP BY movieId",
}, _describe_sql("users", "userId") + " UNION ALL " + _describe_sql("films", "movieId")))
def e3_describe_profiles(spark, sf):
    rated = v.fine_ratings(spark, sf)
    out = [st.describe_profiles(rated, k).select(F.lit(k).alias("key"), "statistic",
                                                 r6("value").alias("value"))
           for k in ("userId", "movieId")]
    return out[0].unionByName(out[1])


_UNIQUE = {
    "sized": "SELECT userId, COUNT(*) OVER (PARTITION BY movieId) AS films FROM fine_ratings",
    "per_user": "SELECT userId, COUNT(*) FILTER (films = 1) AS unique_films FROM sized GROUP BY userId",
}


@query("e4_unique_raters", v.with_views(["fine_ratings"], _UNIQUE, "SELECT * FROM per_user"))
def e4_unique_raters(spark, sf):
    return st.unique_raters(v.fine_ratings(spark, sf))[0]


@query("e4_unique_share", v.with_views(["fine_ratings"], _UNIQUE, """
    SELECT COUNT(*) AS users, COUNT(*) FILTER (unique_films > 0) AS users_with_unique,
           ROUND(COUNT(*) FILTER (unique_films > 0) / COUNT(*), 6) AS share FROM per_user"""))
def e4_unique_share(spark, sf):
    share = st.unique_raters(v.fine_ratings(spark, sf))[1]
    return share.withColumn("share", r6("share"))


@query("e4_unique_description", v.with_views(["fine_ratings"], {
    **_UNIQUE, "positive": "SELECT unique_films AS n FROM per_user WHERE unique_films > 0",
}, _describe_sql("positive", "unique")))
def e4_unique_description(spark, sf):
    described = st.unique_raters(v.fine_ratings(spark, sf))[2]
    return described.select(F.lit("unique").alias("key"), "statistic", r6("value").alias("value"))


@query("e5_histogram", v.with_views(["fine_ratings"], {
    "sizes": "SELECT CAST(COUNT(*) AS DOUBLE) AS x FROM fine_ratings GROUP BY userId "
             "HAVING COUNT(*) BETWEEN 1 AND 100",
    "edges": "SELECT MIN(x) AS a, MAX(x) - MIN(x) AS span FROM sizes",
    "binned": "SELECT LEAST(50, CAST(FLOOR((x - a) * 50 / span) AS INTEGER) + 1) AS bin, "
              "COUNT(*) AS n FROM sizes, edges GROUP BY 1",
}, """
    SELECT CAST(i AS INTEGER) AS bin, ROUND(a + span * (i - 1) / 50, 6) AS "left",
           ROUND(a + span * i / 50, 6) AS "right", COALESCE(n, 0) AS n
    FROM edges, (SELECT UNNEST(range(1, 51)) AS i) LEFT JOIN binned ON bin = i"""))
def e5_histogram(spark, sf):
    sizes = st.profile_sizes(v.fine_ratings(spark, sf), "userId")
    counted = st.histogram(sizes, "n", 50, 1, 100)
    return counted.select("bin", r6("left").alias("left"), r6("right").alias("right"), "n")


@query("e6_popularity_by_user", v.with_views(["fine_ratings"], {
    "sized": "SELECT userId, COUNT(*) OVER (PARTITION BY movieId) AS films FROM fine_ratings",
}, """
    SELECT userId, CAST(COUNT(*) AS DOUBLE) AS num_ratings_user_mean,
           ROUND(AVG(films), 6) AS num_ratings_movie_mean,
           ROUND(STDDEV_SAMP(films), 6) AS num_ratings_movie_std
    FROM sized GROUP BY userId"""))
def e6_popularity_by_user(spark, sf):
    return st.popularity_by_user(v.fine_ratings(spark, sf)).select(
        "userId", "num_ratings_user_mean", r6("num_ratings_movie_mean").alias("num_ratings_movie_mean"),
        r6("num_ratings_movie_std").alias("num_ratings_movie_std"),
    )


@query("e7_sample_users", v.with_views(["ratings"], {
    "chosen": f"SELECT userId FROM (SELECT DISTINCT userId FROM ratings) "
              f"ORDER BY {v.order_key_sql(9, 'userId')}, userId LIMIT 1000",
    "kept": "SELECT * FROM ratings WHERE userId IN (SELECT userId FROM chosen)",
}, """
    SELECT userId, movieId, rating, COUNT(*) OVER (PARTITION BY userId) AS num_ratings_user,
           COUNT(*) OVER (PARTITION BY movieId) AS num_ratings_movie FROM kept"""))
def e7_sample_users(spark, sf):
    return st.sample_users(v.ratings(spark, sf), 1000, seed=9)


@query("e8_top_raters", v.with_views(["ratings"], {}, """
    SELECT userId, COUNT(*) AS n FROM ratings WHERE rating = 5.0 GROUP BY userId"""))
def e8_top_raters(spark, sf):
    return st.top_raters(v.ratings(spark, sf), 5.0)
