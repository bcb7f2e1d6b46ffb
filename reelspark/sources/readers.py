"""Typed readers for the CSV inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.operators.catalogue import MISSING
from reelspark.sources.quoted import read_quoted_csv

RATINGS = "userId BIGINT, movieId BIGINT, rating FLOAT"
MOVIES = (
    "movieId BIGINT, title STRING, genres STRING, year STRING, rated STRING, runtime STRING, "
    "director STRING, writer STRING, actors STRING, plot STRING, language STRING, "
    "country STRING, awards STRING, imdb_rating FLOAT, imdb_votes DOUBLE"
)
LINKS = "movieId BIGINT, imdbId STRING"
GENOME_SCORES = "movieId BIGINT, tagId INT, relevance FLOAT"
GENOME_TAGS = "tagId INT, tag STRING"
TAGS = "userId BIGINT, movieId BIGINT, tag STRING, timestamp BIGINT"


def _csv(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """Columns are found by their name in the header, so further columns in the
    file (a timestamp, other ids) are skipped, and their order does not matter.

    All files of a folder must have the same header: it is read from one of them
    and held against every other, and a file that differs fails the query.
    """
    header = spark.read.csv(path, header=True, inferSchema=False, **options).schema
    named = spark.read.schema(header).csv(path, header=True, enforceSchema=False, **options)
    columns = [c.strip().split(" ") for c in schema.split(",")]
    return named.select(*[F.col(n).cast(t).alias(n) for n, t in columns])


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, RATINGS)


def read_movies(spark: SparkSession, path: str) -> DataFrame:
    """``N/A`` is null; quoted plots may hold quotes and line breaks. A file is read by many tasks."""
    named = read_quoted_csv(spark, path, null_value=MISSING)
    columns = [c.strip().split(" ") for c in MOVIES.split(",")]
    movies = named.select(*[F.col(n).cast(t).alias(n) for n, t in columns])
    return movies.withColumn("imdb_votes", F.col("imdb_votes").cast("bigint"))


def read_genome(spark: SparkSession, scores: str, tags: str) -> DataFrame:
    """(movieId, tagId, tag, relevance); a score without a named tag stays."""
    names = _csv(spark, tags, GENOME_TAGS, escape='"')
    joined = _csv(spark, scores, GENOME_SCORES).join(names, "tagId", "left")
    return joined.select("movieId", "tagId", "tag", "relevance")


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """(movieId, imdbId) with the ``tt`` prefix and the file's leading zeros."""
    links = _csv(spark, path, LINKS)
    return links.withColumn("imdbId", F.concat(F.lit("tt"), "imdbId"))


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, TAGS, escape='"')
