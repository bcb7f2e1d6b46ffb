"""A user's collection, its tags, directors and actors.

Every function takes ``by``: grouping columns such as ``["userId"]`` to handle
all users at once, or none for one collection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspark.functions.text import split_values

BETWEEN = "*|*"
# Separators of the people columns after cleaning.
PEOPLE_SEPARATORS = {"director": "|", "actors": ","}
MOST_SHOWN = 30


def build_collection(
    ratings: DataFrame, movies: DataFrame, users: DataFrame | None = None,
    genomes: DataFrame | None = None, value: float = 5.0,
) -> DataFrame:
    """The films each user rated ``value``, with the catalogue's columns and, if
    given, the list from ``genome_lists`` (empty where a film has none)."""
    owned = ratings.filter(F.col("rating") == F.lit(value)).select("userId", "movieId")
    if users is not None:
        owned = owned.join(users.select("userId"), "userId", "left_semi")
    full = owned.join(movies, "movieId", "left")
    if genomes is not None:
        empty = F.array().cast(genomes.schema["genome"].dataType)
        full = full.join(genomes, "movieId", "left").withColumn(
            "genome", F.coalesce("genome", empty)
        )
    return full


def genome_lists(genome: DataFrame) -> DataFrame:
    """(movieId, genome): (tagId, tag, relevance) sorted by numeric tagId. A list
    holds one entry per tag of the vocabulary."""
    entry = F.struct(
        F.col("tagId").cast("int").alias("tagId"), "tag",
        F.col("relevance").cast("float").alias("relevance"),
    )
    return genome.groupBy("movieId").agg(F.array_sort(F.collect_list(entry)).alias("genome"))


def genome_wide(genome: DataFrame, tags: Sequence[str]) -> DataFrame:
    """One row per film, one column per tag of the given vocabulary."""
    return genome.groupBy("movieId").pivot("tag", list(tags)).agg(F.first("relevance"))


def drop_incomplete(collection: DataFrame) -> DataFrame:
    """Only the films with both director and actors."""
    return collection.dropna(subset=["director", "actors"])


def complete_genome(genome: DataFrame, collection: DataFrame) -> DataFrame:
    """The genome rows of the films kept by ``drop_incomplete``."""
    films = drop_incomplete(collection).select("movieId").distinct()
    return genome.join(films, "movieId", "left_semi")


def _first(df: DataFrame, n: int, by: Sequence[str], *order) -> DataFrame:
    """The first ``n`` rows per group; each task forwards at most ``n`` per group."""
    if not by:
        return df.orderBy(*order).limit(n)
    numbered = df.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return numbered.filter(F.col("_rn") <= n).drop("_rn")


def tag_means(genome: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    mean = F.avg(F.col("relevance").cast("double")).alias("relevance")
    return genome.groupBy(*by, "tag").agg(mean)


def top_tags(genome: DataFrame, n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """The ``n`` tags of highest mean relevance."""
    return _first(tag_means(genome, by), n, by, F.desc("relevance"), F.asc("tag"))


def _best(df: DataFrame, k: int, group: Sequence[str], order: list) -> DataFrame:
    """The first ``k`` rows per group in order, numbered in ``_rn``."""
    numbered = df.withColumn("_rn", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return numbered.filter(F.col("_rn") <= k)


def _joined(best: DataFrame, group: Sequence[str], text) -> DataFrame:
    """``text`` of the numbered rows of each group, as one string."""
    best = best.withColumn("_text", text)
    rows = F.array_sort(F.collect_list(F.struct("_rn", "_text")))  # at most k
    return best.groupBy(*group).agg(F.array_join(rows["_text"], BETWEEN).alias("top_films"))


def top_films_by_tag(
    genome: DataFrame, movies: DataFrame, k: int = 5, by: Sequence[str] = ()
) -> DataFrame:
    """(tag, top_films): titles of the ``k`` most relevant films of each tag."""
    listed = genome.join(movies.select("movieId"), "movieId", "left_semi")
    best = _best(listed, k, [*by, "tag"], [F.desc("relevance"), F.asc("movieId")])
    titled = best.join(movies.select("movieId", "title"), "movieId")  # only the best need a title
    return _joined(titled, [*by, "tag"], F.col("title"))


def _people(collection: DataFrame, group: str) -> DataFrame:
    names = split_values(F.col(group), PEOPLE_SEPARATORS[group], trim=True)
    return collection.withColumn("name", F.explode(names))


def _counted(collection: DataFrame, group: str, by: Sequence[str]) -> DataFrame:
    return _people(collection, group).groupBy(*by, "name").agg(F.count(F.lit(1)).alias("n"))


def people_counts(collection: DataFrame, group: str, by: Sequence[str] = ()) -> DataFrame:
    """(name, n): films per director or actor, most first. A name listed twice
    in a film counts twice."""
    return _counted(collection, group, by).orderBy(*by, F.desc("n"), "name")


def top_films_by_person(
    collection: DataFrame, group: str, k: int = 5, by: Sequence[str] = (), only: DataFrame | None = None
) -> DataFrame:
    """(name, top_films): ``(title,rating)`` of each person's ``k`` best films;
    of the people in ``only`` (by, name) if it is given."""
    films = _people(collection, group).select(*by, "movieId", "name", "title", "imdb_rating")
    if only is not None:
        films = films.join(only, [*by, "name"], "left_semi")
    text = F.concat(
        F.lit("("), "title", F.lit(","),
        F.coalesce(F.col("imdb_rating").cast("string"), F.lit("nan")), F.lit(")"),
    )
    order = [F.desc_nulls_last("imdb_rating"), F.asc("title"), F.asc("movieId")]
    return _joined(_best(films.distinct(), k, [*by, "name"], order), [*by, "name"], text)


def shown(n: int) -> int:
    """The number of bars a panel draws: 1 to ``MOST_SHOWN``."""
    return min(MOST_SHOWN, max(1, n))


def tag_panel(
    genome: DataFrame, movies: DataFrame, n: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    """(tag, relevance, top_films) for the first ``n`` tags."""
    tags = top_tags(genome, shown(n), by)
    keys = [*by, "tag"]
    mine = genome.join(tags.select(*keys), keys, "left_semi")
    return tags.join(top_films_by_tag(mine, movies, 5, by), keys, "left")


def people_panel(
    collection: DataFrame, group: str, n: int = 5, by: Sequence[str] = ()
) -> DataFrame:
    """(name, n, top_films) for the ``n`` people with the most films."""
    counts = _counted(collection, group, by)
    first = _first(counts, shown(n), by, F.desc("n"), F.asc("name"))
    best = top_films_by_person(collection, group, 5, by, only=first.select(*by, "name"))
    return first.join(best, [*by, "name"], "left")
