"""Rating, film and factor tables derived from the driver's tables.

Each view exists twice: as a DataFrame and as DuckDB SQL (``SQL``), from the
same tables and over all of their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions.ordering import (
    MODULUS,
    MODULUS_2,
    MULTIPLIER_ID,
    MULTIPLIER_LAST,
    MULTIPLIER_OTHER,
    MULTIPLIER_STEP,
)
from reelspark.operators.catalogue import clean_catalogue

TEST_SEGMENT = "BUILDING"  # customers of this segment are the unseen users


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _rated(spark: SparkSession, sf: str, movie: Column, keep: Column | None = None) -> DataFrame:
    items = table(spark, sf, "lineitem")
    if keep is not None:
        items = items.filter(keep)
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    stars = (F.ceil(F.max("l_quantity") / 5) / 2).cast("float")
    return (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("userId"), movie.alias("movieId"))
        .agg(stars.alias("rating"))
    )


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    """One rating per customer and part, 0.5 to 5 stars."""
    return _rated(spark, sf, F.col("l_partkey"))


def fine_ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Films are (part, line number): many have a single rater."""
    return _rated(spark, sf, F.col("l_partkey") * 10 + F.col("l_linenumber"))


def base(spark: SparkSession, sf: str) -> DataFrame:
    """Ratings from the lines that were kept, all trained on."""
    kept = _rated(spark, sf, F.col("l_partkey"), F.col("l_returnflag") != "R")
    return kept.withColumn("full_train", F.lit(True))


def batch(spark: SparkSession, sf: str) -> DataFrame:
    """Ratings from the lines that were returned."""
    return _rated(spark, sf, F.col("l_partkey"), F.col("l_returnflag") == "R")


def test_users(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").filter(F.col("c_mktsegment") == TEST_SEGMENT)
    return customers.select(F.col("c_custkey").alias("userId"))


def movies_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Film records as looked up: lists in any order, N/A, mixed certificates."""
    kind, brand, size = F.col("p_type"), F.col("p_brand"), F.col("p_size")
    rated = (
        F.when(kind == "STANDARD", "nr").when(kind == "MEDIUM", "Unrated")
        .when(kind == "PROMO", "M/PG").when(kind == "ECONOMY", "pg")
        .when(kind == "LARGE", "N/A").otherwise("Not Rated")
    )
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("movieId"),
        F.col("p_name").alias("title"),
        F.replace("p_name", F.lit(" "), F.lit("|")).alias("genres"),
        (size + 1950).cast("string").alias("year"),
        rated.alias("rated"),
        text(size.cast("string"), " min").alias("runtime"),
        F.when(brand != "Brand#13", text(kind, ", ", brand)).alias("director"),
        text(brand, " , ", F.col("p_name")).alias("writer"),
        F.when(size != 7, text(kind, ", ", brand, ", ", F.col("p_name"))).alias("actors"),
        text('A "', F.col("p_name"), '" by ', brand, "\nin ", kind).alias("plot"),
        text(kind, ", English").alias("language"),
        text("USA, ", brand).alias("country"),
        F.lit("N/A").alias("awards"),
        F.when(size.isin(11, 22, 33, 44), "N/A")
        .otherwise((size / 5).cast("string")).alias("imdb_rating"),
        F.when(size > 45, "N/A").otherwise(text(size.cast("string"), ",000")).alias("imdb_votes"),
    )


def movies(spark: SparkSession, sf: str) -> DataFrame:
    return clean_catalogue(movies_raw(spark, sf))


def links(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        key.alias("movieId"), F.lpad(key.cast("string"), 7, "0").alias("imdbId")
    )


def genome(spark: SparkSession, sf: str) -> DataFrame:
    """One tag per vector element."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("movieId"), F.posexplode("embedding").alias("p", "v")
    ).select(
        "movieId",
        (F.col("p") + 1).alias("tagId"),
        F.concat(F.lit("tag"), F.col("p") + 1).alias("tag"),
        F.abs("v").alias("relevance"),
    )


TAGS = [f"tag{i}" for i in range(1, 65)]
HALF = 32


def vectors(spark: SparkSession, sf: str, half: int) -> DataFrame:
    """(id, features, label): the first or second half of each vector, made
    non-negative."""
    part = F.slice("embedding", 1 + HALF * half, HALF)
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.transform(part, F.abs).alias("features"), "label"
    )


def film_factors(spark: SparkSession, sf: str, rank: int) -> DataFrame:
    """Factors of rank 1 or 2 for every film of ``ratings``."""
    values = [F.col("p_size") / 50.0, F.col("p_retailprice") / 1000.0][:rank]
    features = F.array(*[v.cast("float") for v in values])
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), features.alias("features"), "p_type"
    )


def known_film_factors(spark: SparkSession, sf: str, rank: int) -> DataFrame:
    """The same without the promotional films, which have no factors yet."""
    films = film_factors(spark, sf, rank).filter(F.col("p_type") != "PROMO")
    return films.select("id", "features")


def customer_factors(spark: SparkSession, sf: str, rank: int) -> DataFrame:
    values = [(F.col("c_nationkey") + 1) / 25.0, F.length("c_mktsegment") / 10.0][:rank]
    features = F.array(*[v.cast("float") for v in values])
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), features.alias("features"), "c_mktsegment"
    )


def known_customer_factors(spark: SparkSession, sf: str, rank: int) -> DataFrame:
    users = customer_factors(spark, sf, rank).filter(F.col("c_mktsegment") != TEST_SEGMENT)
    return users.select("id", "features")


def curves(spark: SparkSession, sf: str) -> DataFrame:
    """An error-like curve per part: (run, j, rmse)."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").alias("run"), F.col("l_linenumber").alias("j"))
        .agg(F.avg("l_quantity").alias("rmse"))
    )


# ---------------------------------------------------------------- DuckDB side


def order_key_sql(seed: int, first: str, second: str | None = None) -> str:
    x = f"((({first}) % {MODULUS}) * {MULTIPLIER_ID} + {seed}) % {MODULUS} * {MULTIPLIER_STEP}"
    if second is not None:
        x = f"{x} + (({second}) % {MODULUS}) * {MULTIPLIER_OTHER}"
    return f"(({x}) % {MODULUS_2} * {MULTIPLIER_LAST}) % {MODULUS}"


def _rated_sql(movie: str, where: str = "") -> str:
    return (
        f"SELECT o_custkey AS userId, {movie} AS movieId, "
        "CAST(CEIL(MAX(l_quantity) / 5) / 2 AS FLOAT) AS rating "
        f"FROM lineitem JOIN orders ON l_orderkey = o_orderkey {where} GROUP BY 1, 2"
    )


_SPACE = "' ' || chr(9) || chr(10) || chr(13)"


def sorted_list_sql(c: str, sep: str, trim: bool) -> str:
    parts = f"string_split({c}, '{sep}')"
    if trim:
        parts = f"list_transform({parts}, lambda x: trim(x, {_SPACE}))"
    return f"rtrim(array_to_string(list_sort({parts}), '|'), '|')"


def number_sql(c: str) -> str:
    return f"CAST(NULLIF(REPLACE({c}, ',', ''), 'N/A') AS DOUBLE)"


def certificate_sql(c: str) -> str:
    return (
        f"REPLACE(REPLACE(REPLACE(UPPER({c}), 'UNRATED', 'NOT RATED'), 'NR', 'NOT RATED'), "
        "'M/PG', 'M')"
    )


SQL = {
    "ratings": _rated_sql("l_partkey"),
    "fine_ratings": _rated_sql("l_partkey * 10 + l_linenumber"),
    "base": _rated_sql("l_partkey", "WHERE l_returnflag <> 'R'"),
    "batch": _rated_sql("l_partkey", "WHERE l_returnflag = 'R'"),
    "test_users": f"SELECT c_custkey AS userId FROM customer WHERE c_mktsegment = '{TEST_SEGMENT}'",
    "movies_raw": """
        SELECT p_partkey AS movieId, p_name AS title, REPLACE(p_name, ' ', '|') AS genres,
               CAST(p_size + 1950 AS VARCHAR) AS year,
               CASE p_type WHEN 'STANDARD' THEN 'nr' WHEN 'MEDIUM' THEN 'Unrated'
                    WHEN 'PROMO' THEN 'M/PG' WHEN 'ECONOMY' THEN 'pg' WHEN 'LARGE' THEN 'N/A'
                    ELSE 'Not Rated' END AS rated,
               CAST(p_size AS VARCHAR) || ' min' AS runtime,
               CASE WHEN p_brand <> 'Brand#13' THEN p_type || ', ' || p_brand END AS director,
               p_brand || ' , ' || p_name AS writer,
               CASE WHEN p_size <> 7 THEN p_type || ', ' || p_brand || ', ' || p_name END AS actors,
               'A "' || p_name || '" by ' || p_brand || chr(10) || 'in ' || p_type AS plot,
               p_type || ', English' AS language, 'USA, ' || p_brand AS country,
               'N/A' AS awards,
               CASE WHEN p_size IN (11, 22, 33, 44) THEN 'N/A'
                    ELSE CAST(CAST(p_size AS DOUBLE) / 5 AS VARCHAR) END AS imdb_rating,
               CASE WHEN p_size > 45 THEN 'N/A'
                    ELSE CAST(p_size AS VARCHAR) || ',000' END AS imdb_votes
        FROM part""",
    "movies": f"""
        SELECT movieId, title, {sorted_list_sql('genres', '|', False)} AS genres, year,
               {certificate_sql('rated')} AS rated, runtime,
               {sorted_list_sql('director', ',', True)} AS director,
               {sorted_list_sql('writer', ',', True)} AS writer, actors, plot,
               {sorted_list_sql('language', ',', True)} AS language,
               {sorted_list_sql('country', ',', True)} AS country, awards,
               {number_sql('imdb_rating')} AS imdb_rating,
               {number_sql('imdb_votes')} AS imdb_votes
        FROM movies_raw""",
    "links": "SELECT p_partkey AS movieId, LPAD(CAST(p_partkey AS VARCHAR), 7, '0') AS imdbId FROM part",
    "genome": """
        SELECT vec_id AS movieId, CAST(i AS INTEGER) AS tagId, 'tag' || CAST(i AS VARCHAR) AS tag,
               ABS(embedding[i]) AS relevance
        FROM embeddings, (SELECT UNNEST(range(1, 65)) AS i)""",
    "first_half": f"""
        SELECT vec_id AS id, list_transform(embedding[1:{HALF}], lambda x: abs(x)) AS features,
               label FROM embeddings""",
    "second_half": f"""
        SELECT vec_id AS id, label,
               list_transform(embedding[{HALF + 1}:{2 * HALF}], lambda x: abs(x)) AS features
        FROM embeddings""",
    "films": """
        SELECT p_partkey AS id, p_type, CAST(CAST(p_size / 50.0 AS FLOAT) AS DOUBLE) AS f1,
               CAST(CAST(p_retailprice / 1000.0 AS FLOAT) AS DOUBLE) AS f2 FROM part""",
    "customers": """
        SELECT c_custkey AS id, c_mktsegment,
               CAST(CAST((c_nationkey + 1) / 25.0 AS FLOAT) AS DOUBLE) AS f1,
               CAST(CAST(LENGTH(c_mktsegment) / 10.0 AS FLOAT) AS DOUBLE) AS f2 FROM customer""",
    "curves": """
        SELECT l_partkey AS run, l_linenumber AS j, AVG(l_quantity) AS rmse
        FROM lineitem GROUP BY 1, 2""",
}
NEEDS = {"movies": ["movies_raw"]}


def with_views(names: list[str], steps: dict[str, str], final: str) -> str:
    """``WITH views, steps final``; views another view needs are added."""
    order: list[str] = []
    for name in names:
        order += [n for n in (*NEEDS.get(name, []), name) if n not in order]
    parts = {**{n: SQL[n] for n in order}, **steps}
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in parts.items()) + f"\n{final}"
