"""Queries for cleaning and completing the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.operators import catalogue as c
from workload import views as v
from workload.registry import query


@query("c1_parse_numeric", v.with_views(["movies_raw"], {}, f"""
    SELECT movieId, {v.number_sql('imdb_votes')} AS imdb_votes,
           {v.number_sql('imdb_rating')} AS imdb_rating FROM movies_raw"""))
def c1_parse_numeric(spark, sf):
    raw = v.movies_raw(spark, sf).select("movieId", "imdb_votes", "imdb_rating")
    return c.parse_numeric(c.parse_numeric(raw, "imdb_votes"), "imdb_rating")


@query("c2_normalise_certificate", v.with_views(["movies_raw"], {}, f"""
    SELECT movieId, {v.certificate_sql('rated')} AS rated FROM movies_raw"""))
def c2_normalise_certificate(spark, sf):
    return c.normalise_certificate(v.movies_raw(spark, sf).select("movieId", "rated"))


@query("c3_canonical_list", v.with_views(["movies"], {}, """
    SELECT movieId, genres, director, writer, language, country FROM movies"""))
def c3_canonical_list(spark, sf):
    columns = {"genres": ("|", False), "director": (",", True), "writer": (",", True),
               "language": (",", True), "country": (",", True)}
    out = v.movies_raw(spark, sf).select("movieId", *columns)
    for name, (sep, trim) in columns.items():
        out = c.canonical_list(out, name, sep, trim)
    return out


@query("c3_clean_catalogue", v.with_views(["movies"], {}, "SELECT * FROM movies"))
def c3_clean_catalogue(spark, sf):
    return c.clean_catalogue(v.movies_raw(spark, sf))


def _counts_sql(column: str, parts: str) -> str:
    return f"""
        SELECT '{column}' AS attribute, value, COUNT(*) AS n
        FROM (SELECT {parts} AS value FROM movies_raw WHERE {column} IS NOT NULL) GROUP BY value"""


@query("c4_value_counts", v.with_views(["movies_raw"], {}, " UNION ALL ".join([
    _counts_sql("genres", "UNNEST(string_split(genres, '|'))"),
    _counts_sql("rated", "rated"),
    _counts_sql("language", "UNNEST(list_transform(string_split(language, ','), lambda x: trim(x)))"),
    _counts_sql("country", "UNNEST(list_transform(string_split(country, ','), lambda x: trim(x)))"),
])))
def c4_value_counts(spark, sf):
    raw = v.movies_raw(spark, sf)
    settings = [("genres", "|", False), ("rated", None, False),
                ("language", ",", True), ("country", ",", True)]
    out = None
    for name, sep, trim in settings:
        counted = c.value_counts(raw, name, sep, trim).withColumn("attribute", F.lit(name))
        out = counted if out is None else out.unionByName(counted)
    return out


def _patch(spark, sf):
    """Catalogue rows of promotional films with another title, plus new films."""
    films = v.movies(spark, sf).filter(F.col("rated") == "M")
    patch = films.withColumn("title", F.concat(F.lit("fixed "), "title"))
    return patch.unionByName(patch.withColumn("movieId", -F.col("movieId") - 1))


@query("c5_override_rows", v.with_views(["movies"], {
    "patch": "SELECT * REPLACE ('fixed ' || title AS title) FROM movies WHERE rated = 'M'",
}, """
    SELECT movieId, title, genres FROM movies WHERE movieId NOT IN (SELECT movieId FROM patch)
    UNION ALL SELECT movieId, title, genres FROM patch
    UNION ALL SELECT -movieId - 1, title, genres FROM patch"""))
def c5_override_rows(spark, sf):
    fixed = c.override_rows(v.movies(spark, sf), _patch(spark, sf), "movieId")
    return fixed.select("movieId", "title", "genres")


def _enriched(spark, sf):
    """The catalogue starts without directors and votes; records exist for the
    films that are not promotional."""
    full = v.movies(spark, sf)
    links = v.links(spark, sf).withColumn("imdbId", F.concat(F.lit("tt"), "imdbId"))
    records = (
        full.filter(F.col("rated") != "M")
        .withColumn("awards", F.nullif("awards", F.lit("N/A")))
        .withColumn("rated", F.nullif("rated", F.lit("N/A")))
        .join(links, "movieId")
        .drop("movieId", "genres")
    )
    bare = full.withColumn("director", F.lit("unknown")).withColumn("imdb_votes", F.lit(0.0))
    return c.enrich(bare, links, records)


_RECORDS = """
    SELECT 'tt' || imdbId AS imdbId, movies.* REPLACE (NULLIF(rated, 'N/A') AS rated,
           CAST(NULL AS VARCHAR) AS awards)
    FROM movies JOIN links USING (movieId) WHERE rated <> 'M'"""


@query("c6_enrich", v.with_views(["movies", "links"], {"records": _RECORDS}, """
    SELECT m.movieId, m.title, COALESCE(r.rated, m.rated) AS rated,
           COALESCE(r.director, 'unknown') AS director, m.actors,
           COALESCE(r.imdb_votes, 0.0) AS imdb_votes
    FROM movies m LEFT JOIN records r ON m.movieId = r.movieId"""))
def c6_enrich(spark, sf):
    filled, _ = _enriched(spark, sf)
    return filled.select("movieId", "title", "rated", "director", "actors", "imdb_votes")


@query("c6_enrich_gaps", v.with_views(["movies", "links"], {"records": _RECORDS}, """
    SELECT 'tt' || l.imdbId AS imdbId,
           CASE WHEN r.movieId IS NULL THEN 'title' WHEN r.rated IS NULL THEN 'rated'
                WHEN r.director IS NULL THEN 'director' WHEN r.actors IS NULL THEN 'actors'
                ELSE 'awards' END AS field
    FROM links l LEFT JOIN records r ON l.movieId = r.movieId"""))
def c6_enrich_gaps(spark, sf):
    return _enriched(spark, sf)[1]
