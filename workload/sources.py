"""Queries for the readers, keyed appends, model folders and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.functions.lineage import scratch
from reelspark.plans.model import Model, Params, no_ids
from reelspark.sources.keyed_table import KeyedTable
from reelspark.sources.model_store import load_model, load_predictions, save_model
from reelspark.sources.readers import (
    read_genome,
    read_links,
    read_movies,
    read_ratings,
    read_tags,
)
from reelspark.sources.tables import (
    TABLE_KEYS,
    append_table,
    export_csv,
    key_violations,
    read_table,
)
from workload import views as v
from workload.registry import flat, query


@query("s1_read_ratings", v.with_views(["ratings"], {}, "SELECT userId, movieId, rating FROM ratings"))
def s1_read_ratings(spark, sf):
    path = scratch(spark, "ratings")
    export_csv(v.ratings(spark, sf).withColumn("timestamp", F.lit(0)), path)
    return read_ratings(spark, path)


@query("s2_read_movies", v.with_views(["movies"], {}, """
    SELECT movieId, title, genres, year, NULLIF(rated, 'N/A') AS rated, runtime, director, writer,
           actors, plot, language, country, CAST(NULL AS VARCHAR) AS awards,
           CAST(imdb_rating AS FLOAT) AS imdb_rating, CAST(imdb_votes AS BIGINT) AS imdb_votes
    FROM movies"""))
def s2_read_movies(spark, sf):
    path = scratch(spark, "movies")
    export_csv(v.movies(spark, sf), path)
    return read_movies(spark, path)


@query("s3_read_genome", v.with_views(["genome"], {}, "SELECT movieId, tagId, tag, relevance FROM genome"))
def s3_read_genome(spark, sf):
    scores, tags = scratch(spark, "genome-scores"), scratch(spark, "genome-tags")
    genome = v.genome(spark, sf)
    export_csv(genome, scores, ["movieId", "tagId", "relevance"])
    export_csv(genome.select("tagId", "tag").distinct(), tags)
    return read_genome(spark, scores, tags)


@query("s4_read_links", v.with_views(["links"], {}, "SELECT movieId, 'tt' || imdbId AS imdbId FROM links"))
def s4_read_links(spark, sf):
    path = scratch(spark, "links")
    export_csv(v.links(spark, sf).withColumn("tmdbId", F.lit(1)), path)
    return read_links(spark, path)


@query("s4_read_tags", """
    SELECT user_id AS userId, event_id AS movieId, props AS tag, epoch_us(ts) // 1000000 AS timestamp
    FROM events""")
def s4_read_tags(spark, sf):
    path = scratch(spark, "tags")
    events = v.table(spark, sf, "events")
    export_csv(
        events.select(
            F.col("user_id").alias("userId"), F.col("event_id").alias("movieId"),
            F.col("props").alias("tag"), F.unix_timestamp("ts").alias("timestamp"),
        ),
        path,
    )
    return read_tags(spark, path)


@query("s5_key_violations", """
    SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem
    GROUP BY 1, 2 HAVING COUNT(*) > 1""")
def s5_key_violations(spark, sf):
    return key_violations(v.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("s5_append_table", v.with_views(["base", "batch"], {}, """
    SELECT * FROM base UNION ALL
    SELECT * FROM batch ANTI JOIN base USING (userId, movieId)"""))
def s5_append_table(spark, sf):
    path, keys = scratch(spark, "table"), ["userId", "movieId"]
    append_table(v.base(spark, sf).drop("full_train"), path, keys)
    append_table(v.batch(spark, sf), path, keys, skip_present=True)
    return read_table(spark, path)


@query("s5_append_keyed", v.with_views(["base", "batch"], {}, """
    SELECT * FROM base UNION ALL
    SELECT * FROM batch ANTI JOIN base USING (userId, movieId)"""))
def s5_append_keyed(spark, sf):
    """The same in one step each, keys compared only with the files that can hold them."""
    table = KeyedTable(spark, scratch(spark, "keyed"), ["userId", "movieId"])
    table.append(v.base(spark, sf).drop("full_train"))
    table.append(v.batch(spark, sf), skip_present=True)
    return table.read()


@query("s5_append_tables", v.with_views(["ratings", "movies", "genome"], {}, """
    SELECT 'movies' AS name, COUNT(*) AS n FROM movies
    UNION ALL SELECT 'links', COUNT(*) FROM movies
    UNION ALL SELECT 'genome_tags', COUNT(DISTINCT tagId) FROM genome
    UNION ALL SELECT 'genome_scores', COUNT(*) FROM genome
    UNION ALL SELECT 'tags', 2 * COUNT(*) FROM ratings"""))
def s5_append_tables(spark, sf):
    """The other related tables: each appended twice, which only tables without
    a key take as further rows."""
    movies, genome = v.movies(spark, sf), v.genome(spark, sf)
    rows = {
        "movies": movies,
        "links": movies.select("movieId", F.lpad(F.col("movieId").cast("string"), 7, "0").alias("imdbId")),
        "genome_tags": genome.select("tagId", "tag").distinct(),
        "genome_scores": genome.select("movieId", "tagId", "relevance"),
        "tags": v.ratings(spark, sf).select("userId", "movieId", F.lit("seen").alias("tag")),
    }
    out = None
    for name, df in rows.items():
        path = scratch(spark, name)
        for _ in range(2):
            append_table(df, path, TABLE_KEYS[name], skip_present=True)
        counted = read_table(spark, path).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = counted if out is None else out.unionByName(counted)
    return out


def _saved(spark, sf) -> str:
    users = v.vectors(spark, sf, 1).select("id", "features")
    items = v.vectors(spark, sf, 0).select("id", "features")
    model = Model(Params(rank=v.HALF), users, items, v.base(spark, sf), no_ids(users), no_ids(items))
    path = scratch(spark, "model")
    predictions = v.batch(spark, sf).withColumnRenamed("rating", "predictedRating")
    save_model(model, path, with_ratings=True, predictions=predictions)
    return path


@query("s6_save_model", v.with_views(["second_half", "first_half"], {}, """
    SELECT 'user' AS side, id, i AS pos, ROUND(CAST(features[i] AS DOUBLE), 6) AS value
    FROM second_half, (SELECT UNNEST(range(1, 33)) AS i)
    UNION ALL
    SELECT 'item', id, i, ROUND(CAST(features[i] AS DOUBLE), 6)
    FROM first_half, (SELECT UNNEST(range(1, 33)) AS i)"""))
def s6_save_model(spark, sf):
    path = _saved(spark, sf)
    read = lambda part: spark.read.schema("id BIGINT, features ARRAY<FLOAT>").json(f"{path}/{part}")
    users = flat(read("userFactors")).withColumn("side", F.lit("user"))
    return users.unionByName(flat(read("itemFactors")).withColumn("side", F.lit("item")))


@query("s7_load_model", v.with_views(["base", "batch", "first_half"], {}, """
    SELECT 'rating' AS part, userId AS a, movieId AS b, CAST(rating AS DOUBLE) AS value FROM base
    UNION ALL SELECT 'prediction', userId, movieId, rating FROM batch
    UNION ALL SELECT 'item', id, i, ROUND(CAST(features[i] AS DOUBLE), 6)
    FROM first_half, (SELECT UNNEST(range(1, 33)) AS i)"""))
def s7_load_model(spark, sf):
    path = _saved(spark, sf)
    model = load_model(spark, path)
    parts = {
        "rating": model.ratings.filter("full_train").select("userId", "movieId", "rating"),
        "prediction": load_predictions(spark, path),
        "item": flat(model.item_factors),
        "updated": model.updated_users.selectExpr("id", "id", "0 AS value"),
    }
    out = None
    for name, df in parts.items():
        df = df.toDF("a", "b", "value").select(
            F.lit(name).alias("part"), "a", F.col("b").cast("bigint").alias("b"),
            F.col("value").cast("double").alias("value"),
        )
        out = df if out is None else out.unionByName(df)
    return out


@query("s8_export_csv", v.with_views(["ratings"], {}, "SELECT userId, movieId, rating FROM ratings"))
def s8_export_csv(spark, sf):
    path = scratch(spark, "export")
    sized = v.ratings(spark, sf).withColumn("note", F.lit('left "out", always'))
    export_csv(sized, path, ["userId", "movieId", "rating"])
    return spark.read.csv(path, header=True, schema="userId BIGINT, movieId BIGINT, rating FLOAT")
