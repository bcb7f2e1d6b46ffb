"""Queries for collection analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.operators import collection as k
from workload import views as v
from workload.registry import query, r6


def _collection(spark, sf):
    return k.build_collection(v.ratings(spark, sf), v.movies(spark, sf))


_OWNED = {
    "owned": "SELECT userId, movieId FROM ratings WHERE rating = 5.0",
    "collection": "SELECT o.userId, m.* FROM owned o LEFT JOIN movies m ON m.movieId = o.movieId",
}


@query("k1_build_collection", v.with_views(["ratings", "movies", "genome"], {
    **_OWNED, "sizes": "SELECT movieId, COUNT(*) AS n FROM genome GROUP BY movieId",
}, """
    SELECT userId, c.movieId, title, genres, director, actors, imdb_rating,
           CAST(COALESCE(n, 0) AS INTEGER) AS tags
    FROM collection c LEFT JOIN sizes s ON s.movieId = c.movieId"""))
def k1_build_collection(spark, sf):
    genomes = k.genome_lists(v.genome(spark, sf))
    full = k.build_collection(v.ratings(spark, sf), v.movies(spark, sf), genomes=genomes)
    return full.select("userId", "movieId", "title", "genres", "director", "actors",
                       "imdb_rating", F.size("genome").alias("tags"))


@query("k2_genome_lists", v.with_views(["genome"], {}, """
    SELECT movieId, CAST(ROW_NUMBER() OVER (PARTITION BY movieId ORDER BY tagId) AS INTEGER) AS position,
           tagId, tag, relevance FROM genome"""))
def k2_genome_lists(spark, sf):
    listed = k.genome_lists(v.genome(spark, sf))
    return listed.select("movieId", F.posexplode("genome").alias("p", "g")).select(
        "movieId", (F.col("p") + 1).alias("position"), "g.tagId", "g.tag", "g.relevance")


@query("k3_genome_wide", v.with_views(["genome"], {}, "SELECT movieId, " + ", ".join(
    f"MAX(relevance) FILTER (tag = '{t}') AS {t}" for t in v.TAGS) + " FROM genome GROUP BY movieId"))
def k3_genome_wide(spark, sf):
    return k.genome_wide(v.genome(spark, sf), v.TAGS)


@query("k4_drop_incomplete", v.with_views(["ratings", "movies"], _OWNED, """
    SELECT userId, movieId, director, actors FROM collection
    WHERE director IS NOT NULL AND actors IS NOT NULL"""))
def k4_drop_incomplete(spark, sf):
    return k.drop_incomplete(_collection(spark, sf)).select("userId", "movieId", "director", "actors")


@query("k4_complete_genome", v.with_views(["movies", "genome"], {}, """
    SELECT * FROM genome WHERE movieId IN (
        SELECT movieId FROM movies WHERE director IS NOT NULL AND actors IS NOT NULL)"""))
def k4_complete_genome(spark, sf):
    return k.complete_genome(v.genome(spark, sf), v.movies(spark, sf))


def _owned_genome(spark, sf):
    owned = v.ratings(spark, sf).filter(F.col("rating") == 5.0).select("userId", "movieId")
    return owned.join(v.genome(spark, sf), "movieId")


_MINE = "SELECT userId, genome.* FROM owned JOIN genome USING (movieId)"


def _tags_sql(source: str, by: str, n: int) -> str:
    keys = f"{by}, tag" if by else "tag"
    part = f"PARTITION BY {by}" if by else ""
    return f"""
        SELECT {keys}, relevance FROM (
            SELECT *, ROW_NUMBER() OVER ({part} ORDER BY relevance DESC, tag) AS rn
            FROM (SELECT {keys}, AVG(CAST(relevance AS DOUBLE)) AS relevance
                  FROM {source} GROUP BY {keys})) WHERE rn <= {n}"""


@query("k5_top_tags", v.with_views(["genome"], {"top": _tags_sql("genome", "", 10)}, """
    SELECT tag, ROUND(relevance, 6) AS relevance FROM top"""))
def k5_top_tags(spark, sf):
    return k.top_tags(v.genome(spark, sf), 10).withColumn("relevance", r6("relevance"))


@query("k5_top_tags_by_user", v.with_views(["ratings", "genome"], {
    "owned": _OWNED["owned"], "mine": _MINE, "top": _tags_sql("mine", "userId", 10),
}, "SELECT userId, tag, ROUND(relevance, 6) AS relevance FROM top"))
def k5_top_tags_by_user(spark, sf):
    top = k.top_tags(_owned_genome(spark, sf), 10, ["userId"])
    return top.withColumn("relevance", r6("relevance"))


def _films_sql(source: str, keys: str) -> str:
    return f"""
        SELECT {keys}, STRING_AGG(title, '*|*' ORDER BY rn) AS top_films FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY relevance DESC, movieId) AS rn
            FROM {source} JOIN movies USING (movieId)) WHERE rn <= 5 GROUP BY {keys}"""


@query("k6_top_films_by_tag", v.with_views(["movies", "genome"], {}, _films_sql("genome", "tag")))
def k6_top_films_by_tag(spark, sf):
    return k.top_films_by_tag(v.genome(spark, sf), v.movies(spark, sf))


def _people_sql(column: str, sep: str) -> str:
    return f"""
        SELECT *, UNNEST(list_transform(string_split({column}, '{sep}'), lambda x: trim(x))) AS name
        FROM collection WHERE {column} IS NOT NULL"""


_COUNTED = "SELECT name, COUNT(*) AS n FROM people GROUP BY name"
_BEST = """
    SELECT {keys}, STRING_AGG(text, '*|*' ORDER BY rn) AS top_films FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY {keys}
                                     ORDER BY imdb_rating DESC NULLS LAST, title, movieId) AS rn,
               '(' || title || ',' || COALESCE(CAST(imdb_rating AS VARCHAR), 'nan') || ')' AS text
        FROM (SELECT DISTINCT {keys}, movieId, title, imdb_rating FROM people))
    WHERE rn <= 5 GROUP BY {keys}"""


for _group, _sep in (("director", "|"), ("actors", ",")):
    _steps = {**_OWNED, "people": _people_sql(_group, _sep)}

    @query(f"k7_people_counts_{_group}", v.with_views(["ratings", "movies"], _steps, _COUNTED))
    def k7_people_counts(spark, sf, group=_group):
        return k.people_counts(_collection(spark, sf), group)

    @query(f"k8_top_films_by_{_group}",
           v.with_views(["ratings", "movies"], _steps, _BEST.format(keys="name")))
    def k8_top_films_by_person(spark, sf, group=_group):
        return k.top_films_by_person(_collection(spark, sf), group)

    @query(f"k9_people_panel_{_group}", v.with_views(["ratings", "movies"], {
        **_steps,
        "counted": "SELECT userId, name, COUNT(*) AS n FROM people GROUP BY userId, name",
        "ranked": "SELECT *, ROW_NUMBER() OVER (PARTITION BY userId ORDER BY n DESC, name) AS rn "
                  "FROM counted",
        "best": _BEST.format(keys="userId, name"),
    }, """
        SELECT r.userId, r.name, r.n, b.top_films
        FROM ranked r JOIN best b ON r.userId = b.userId AND r.name = b.name WHERE rn <= 5"""))
    def k9_people_panel(spark, sf, group=_group):
        return k.people_panel(_collection(spark, sf), group, 5, ["userId"])


@query("k9_tag_panel", v.with_views(["movies", "genome"], {
    "top": _tags_sql("genome", "", 30), "best": _films_sql("genome", "tag"),
}, "SELECT tag, ROUND(relevance, 6) AS relevance, top_films FROM top LEFT JOIN best USING (tag)"))
def k9_tag_panel(spark, sf):
    panel = k.tag_panel(v.genome(spark, sf), v.movies(spark, sf), 45)
    return panel.withColumn("relevance", r6("relevance"))


@query("k9_tag_panel_by_user", v.with_views(["ratings", "movies", "genome"], {
    "owned": _OWNED["owned"], "mine": _MINE,
    "top": _tags_sql("mine", "userId", 10), "best": _films_sql("mine", "userId, tag"),
}, """
    SELECT userId, tag, ROUND(relevance, 6) AS relevance, top_films
    FROM top LEFT JOIN best USING (userId, tag)"""))
def k9_tag_panel_by_user(spark, sf):
    panel = k.tag_panel(_owned_genome(spark, sf), v.movies(spark, sf), 10, ["userId"])
    return panel.withColumn("relevance", r6("relevance"))
