"""Queries for the factor model."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.functions.lineage import cut, scratch
from reelspark.functions.vectors import dot
from reelspark.operators import factors as fa
from reelspark.operators import foldin, scoring
from reelspark.operators import ratings as ra
from reelspark.plans.incremental import apply_batch, apply_to_store
from reelspark.plans.model import Model, Params, fit, fit_implicit, implicit_labels, no_ids, recommend
from reelspark.sources.ratings_store import RatingsStore
from workload import views as v
from workload.registry import flat, query

ITERS, REG = 3, 0.1


def _stationary(model, rank: int):
    """(userId, stationary): whether a user's factors solve the penalised problem
    over the user's ratings with the films given, as the last step of a fit does:
    no gradient where a factor is positive, none that points down where it is 0."""
    reg = model.params.reg
    u = model.user_factors.select(F.col("id").alias("userId"), F.col("features").alias("u"))
    i = model.item_factors.select(F.col("id").alias("movieId"), F.col("features").alias("i"))
    rated = model.ratings.join(i, "movieId").join(u, "userId")
    product = dot(F.col("u"), F.col("i"), rank)
    sums = rated.withColumn("miss", product - F.col("rating")).groupBy("userId").agg(
        F.count(F.lit(1)).alias("n"), F.any_value("u").alias("u"),
        *[F.sum(F.col("miss") * F.get("i", F.lit(k))).alias(f"g{k}") for k in range(rank)])
    met = F.lit(True)
    for k in range(rank):
        x = F.get("u", F.lit(k))
        slope = (F.col(f"g{k}") + F.lit(reg) * F.col("n") * x) / F.col("n")
        met = met & (slope > -1e-3) & ((x == 0) | (slope < 1e-3))
    return sums.select("userId", met.alias("stationary"))


def _stationary_implicit(model, rank: int, alpha: float = 1.0):
    """``_stationary`` for implicit feedback: every film counts, as liked or not, one with
    a rating r by 1 + alpha * |r|; the penalty is by the number of liked films.

    The part of the films without a rating is the sum of all films' outer
    products, rank * rank numbers, which are brought to the driver.
    """
    reg = model.params.reg
    u = model.user_factors.select(F.col("id").alias("userId"), F.col("features").alias("u"))
    i = model.item_factors.select(F.col("id").alias("movieId"), F.col("features").alias("i"))
    at = lambda v, k: F.get(v, F.lit(k)).cast("double")
    outer = i.agg(*[F.sum(at("i", a) * at("i", b)) for a in range(rank) for b in range(rank)]).first()
    rated = model.ratings.join(i, "movieId").join(u, "userId").withColumn("more", F.lit(alpha) * F.abs("rating"))
    liked = (F.col("rating") > 0).cast("double")
    miss = F.col("more") * dot(F.col("u"), F.col("i"), rank) - liked * (1 + F.col("more"))
    sums = rated.withColumn("liked", liked).withColumn("miss", miss).groupBy("userId").agg(
        F.sum("liked").alias("n"), F.any_value("u").alias("u"),
        *[F.sum(F.col("miss") * at("i", k)).alias(f"g{k}") for k in range(rank)])
    met = F.lit(True)
    for k in range(rank):
        x = at("u", k)
        whole = sum((F.lit(outer[k * rank + j]) * at("u", j) for j in range(rank)), F.lit(0.0))
        slope = (F.col(f"g{k}") + whole + F.lit(reg) * F.col("n") * x) / (F.col("n") + 1)
        met = met & (slope > -1e-3) & ((x == 0) | (slope < 1e-3))
    return sums.select("userId", met.alias("stationary"))


def _fitted(model, rank: int = 10, check=_stationary):
    """``_summary`` and, for users, whether the fit's last step is solved."""
    solved = check(model, rank).select(
        F.lit("user").alias("side"), F.col("userId").alias("id"), "stationary")
    return _summary(model).join(solved, ["side", "id"], "left").withColumn(
        "stationary", F.coalesce("stationary", F.col("side") == "item"))


def _summary(model):
    """(side, id, size, nonnegative): what must hold of any fit."""
    out = None
    for side, factors in (("user", model.user_factors), ("item", model.item_factors)):
        one = factors.select(
            F.lit(side).alias("side"), "id", F.size("features").alias("size"),
            F.forall("features", lambda x: x >= 0).alias("nonnegative"),
        )
        out = one if out is None else out.unionByName(one)
    return out


_FIT = """
    SELECT 'user' AS side, userId AS id, 10 AS size, true AS nonnegative
    FROM (SELECT DISTINCT userId FROM ratings)
    UNION ALL SELECT 'item', movieId, 10, true FROM (SELECT DISTINCT movieId FROM ratings)"""


@query("f1_fit", v.with_views(["ratings"], {}, f"SELECT *, true AS stationary FROM ({_FIT})"))
def f1_fit(spark, sf):
    return _fitted(fit(cut(v.ratings(spark, sf)), Params(rank=10, iters=5)))


@query("f1_fit_recommend", v.with_views(["ratings"], {}, """
    SELECT userId, CAST(UNNEST(range(1, 1 + LEAST(20, (SELECT COUNT(DISTINCT movieId) FROM ratings) - n)))
                        AS INTEGER) AS position, true AS unseen
    FROM (SELECT userId, COUNT(*) AS n FROM ratings GROUP BY userId)"""))
def f1_fit_recommend(spark, sf):
    """Twenty films, or as many as there are, for every user, none of them rated.
    Which films is up to the fit."""
    rated = cut(v.ratings(spark, sf))
    top = recommend(fit(rated, Params(rank=10, iters=5)), n=20)
    seen = rated.select("userId", "movieId", F.lit(False).alias("unseen"))
    return top.join(seen, ["userId", "movieId"], "left").select(
        "userId", "position", F.coalesce("unseen", F.lit(True)).alias("unseen"))


@query("f2_implicit_labels", v.with_views(["ratings"], {}, """
    SELECT userId, movieId, CAST(rating >= 4.0 AS INTEGER) AS rating FROM ratings"""))
def f2_implicit_labels(spark, sf):
    return implicit_labels(v.ratings(spark, sf))


@query("f2_fit_implicit", v.with_views(["ratings"], {}, f"SELECT *, true AS stationary FROM ({_FIT})"))
def f2_fit_implicit(spark, sf):
    model = fit_implicit(cut(v.ratings(spark, sf)), Params(rank=10, iters=5))
    return _fitted(model, check=_stationary_implicit)


_SCORED = {
    "scored": """
        SELECT u.id AS userId, i.id AS movieId,
               CAST(list_inner_product(CAST(u.features AS DOUBLE[]), CAST(i.features AS DOUBLE[]))
                    AS FLOAT) AS predictedRating
        FROM second_half u, first_half i
        WHERE (u.id, i.id) NOT IN (SELECT (userId, movieId) FROM ratings)""",
}


def _halves(spark, sf):
    return v.vectors(spark, sf, 1), v.vectors(spark, sf, 0), v.ratings(spark, sf)


def _asking(spark, sf):
    """The users that predictions are asked for."""
    few = v.vectors(spark, sf, 1).filter(F.col("label") <= 4)
    return few.select(F.col("id").alias("userId"))


_ASKED = "userId IN (SELECT id FROM second_half WHERE label <= 4)"


@query("f3_predict_unseen", v.with_views(["ratings", "first_half", "second_half"], _SCORED, f"""
    SELECT userId, movieId, ROUND(CAST(predictedRating AS DOUBLE), 4) AS predictedRating
    FROM scored WHERE {_ASKED}"""))
def f3_predict_unseen(spark, sf):
    scored = scoring.predict_unseen(*_halves(spark, sf), rank=v.HALF, users=_asking(spark, sf))
    value = F.round(F.col("predictedRating").cast("double"), 4)
    return scored.withColumn("predictedRating", value)


def _best_sql(where: str = "true") -> str:
    return f"""
    SELECT userId, movieId, ROUND(CAST(predictedRating AS DOUBLE), 4) AS predictedRating,
           CAST(position AS INTEGER) AS position
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY userId
                                       ORDER BY predictedRating DESC, movieId) AS position
          FROM scored WHERE {where}) WHERE position <= 20"""


def _best(spark, sf, **how):
    top = scoring.recommend_top(*_halves(spark, sf), rank=v.HALF, n=20, **how)
    value = F.round(F.col("predictedRating").cast("double"), 4)
    return top.withColumn("predictedRating", value)


@query("f4_recommend", v.with_views(["ratings", "first_half", "second_half"], _SCORED, _best_sql()))
def f4_recommend(spark, sf):
    return _best(spark, sf)


@query("f4_recommend_users", v.with_views(
    ["ratings", "first_half", "second_half"], _SCORED, _best_sql(_ASKED)))
def f4_recommend_users(spark, sf):
    return _best(spark, sf, users=_asking(spark, sf))


@query("f4_recommend_blocks", v.with_views(["ratings", "first_half", "second_half"], _SCORED, _best_sql()))
def f4_recommend_blocks(spark, sf):
    """The same over a grid of many small blocks."""
    return _best(spark, sf, per_block=(64, 96))


_UPSERTED = """
    SELECT COALESCE(b.userId, n.userId) AS userId, COALESCE(b.movieId, n.movieId) AS movieId,
           COALESCE(n.rating, b.rating) AS rating,
           CASE WHEN b.userId IS NOT NULL THEN true END AS full_train
    FROM base b FULL JOIN batch n ON b.userId = n.userId AND b.movieId = n.movieId"""


_OWNED = _UPSERTED.replace(
    "COALESCE(n.rating, b.rating)",
    "CAST(CASE WHEN n.userId IS NOT NULL THEN 4.0 ELSE b.rating END AS FLOAT)")
_REMOVED = "SELECT *, true AS full_train FROM base ANTI JOIN batch USING (userId, movieId)"


@query("f5_upsert_ratings", v.with_views(["base", "batch"], {}, _UPSERTED))
def f5_upsert_ratings(spark, sf):
    return ra.upsert_ratings(v.base(spark, sf), v.batch(spark, sf))


@query("f6_add_to_collection", v.with_views(["base", "batch"], {}, _OWNED))
def f6_add_to_collection(spark, sf):
    return ra.add_to_collection(v.base(spark, sf), v.batch(spark, sf).select("userId", "movieId"))


@query("f7_remove_ratings", v.with_views(["ratings", "batch"], {}, """
    SELECT * FROM ratings ANTI JOIN batch USING (userId, movieId)"""))
def f7_remove_ratings(spark, sf):
    return ra.remove_ratings(v.ratings(spark, sf), v.batch(spark, sf))


def _touched_sql(key: str) -> str:
    """The rows of small profiles that ``batch`` touches in ``upserted``, by plain joins."""
    return f"""
        SELECT upserted.userId AS userId, upserted.movieId AS movieId, upserted.rating AS rating
        FROM upserted JOIN (
            SELECT asked.id AS id
            FROM upserted JOIN (SELECT {key} AS id FROM batch GROUP BY {key}) asked ON upserted.{key} = asked.id
            GROUP BY asked.id HAVING COUNT(upserted.full_train) <= 20) small ON upserted.{key} = small.id"""


def _selected_sql(key: str) -> str:
    """The same from tables that are made once."""
    return (f"WITH base AS MATERIALIZED ({v.SQL['base']}), batch AS MATERIALIZED ({v.SQL['batch']}), "
            f"upserted AS MATERIALIZED ({_UPSERTED}) {_touched_sql(key)}")


def _selected(spark, sf, side: int):
    """The rows of one side, written once, so that whoever reads them starts no work again."""
    batch = cut(v.batch(spark, sf))
    ratings = cut(ra.upsert_ratings(cut(v.base(spark, sf)), batch))
    return cut(ra.select_for_update(ratings, batch, 20)[side])


@query("f8_select_users", _selected_sql("userId"))
def f8_select_users(spark, sf):
    return _selected(spark, sf, 0)


@query("f8_select_films", _selected_sql("movieId"))
def f8_select_films(spark, sf):
    return _selected(spark, sf, 1)


def known_solve_sql(rows: str, entity: str, rank: int, extra: str = "") -> str:
    """Non-negative ridge solve of rank 1 or 2 over ``rows`` (entity, a1, a2, b)."""
    keys = f"{entity}{extra}"
    if rank == 1:
        return f"""
            SELECT {keys}, GREATEST(0, SUM(a1 * b)) / (SUM(a1 * a1) + {REG}) AS w1
            FROM {rows} GROUP BY {keys}"""
    return f"""
        SELECT {keys},
               CASE WHEN u1 < 0 THEN 0 WHEN u2 < 0 THEN GREATEST(0, c1 / g11) ELSE u1 END AS w1,
               CASE WHEN u2 < 0 THEN 0 WHEN u1 < 0 THEN GREATEST(0, c2 / g22) ELSE u2 END AS w2
        FROM (SELECT *, (c1 * g22 - c2 * g12) / (g11 * g22 - g12 * g12) AS u1,
                     (c2 * g11 - c1 * g12) / (g11 * g22 - g12 * g12) AS u2
              FROM (SELECT {keys}, SUM(a1 * a1) + {REG} AS g11, SUM(a2 * a2) + {REG} AS g22,
                           SUM(a1 * a2) AS g12, SUM(a1 * b) AS c1, SUM(a2 * b) AS c2
                    FROM {rows} GROUP BY {keys}))"""


def mixed_solve_steps(prefix: str, rows: str, entity: str, iters: int = ITERS) -> dict[str, str]:
    """CTEs for the rank-1 solve with unknown rows (a1 null in ``rows``): the last
    step ``{prefix}_done`` has (entity, w, d, unknown)."""
    steps = {
        f"{prefix}_sums": f"""
            SELECT {entity}, COALESCE(SUM(a1 * a1), 0) + {REG} AS g, COALESCE(SUM(a1 * b), 0) AS c,
                   COUNT(*) FILTER (a1 IS NULL) AS unknown,
                   COALESCE(SUM(b) FILTER (a1 IS NULL), 0) AS s1,
                   COALESCE(SUM(b * SQRT(b)) FILTER (a1 IS NULL), 0) AS s15,
                   COALESCE(SUM(b * b) FILTER (a1 IS NULL), 0) AS s2
            FROM {rows} GROUP BY {entity}""",
        f"{prefix}_0": f"SELECT *, (c + s15) / (g + s1) AS w, 0.0::DOUBLE AS d FROM {prefix}_sums",
    }
    for i in range(1, iters + 1):
        steps[f"{prefix}_{i}"] = f"""
            SELECT * REPLACE (CASE WHEN unknown > 0 THEN (c + s2 * d) / (g + s2 * d * d) ELSE w END AS w)
            FROM (SELECT * REPLACE (w / (w * w + {REG}) AS d) FROM {prefix}_{i - 1})"""
    steps[f"{prefix}_done"] = f"SELECT {entity}, w, d, unknown FROM {prefix}_{iters}"
    return steps


def _rows_sql(table: str, factors: str, key: str, where: str = "") -> str:
    return f"""
        SELECT r.userId, r.movieId, CAST(r.rating AS DOUBLE) AS b, f.f1 AS a1, f.f2 AS a2
        FROM {table} r LEFT JOIN {factors} f ON r.{key} = f.id {where}"""


def _flat_sql(source: str, entity: str, rank: int) -> str:
    return " UNION ALL ".join(
        f"SELECT {entity} AS id, CAST({i} AS BIGINT) AS pos, ROUND(CAST(CAST(w{i} AS FLOAT) AS DOUBLE), 5) AS value "
        f"FROM {source}" for i in range(1, rank + 1))


def _flat5(factors):
    return flat(factors, digits=5)


for _rank in (1, 2):

    @query(f"f9_fold_in_users_rank{_rank}", v.with_views(["ratings", "films"], {
        "rated": _rows_sql("ratings", "films", "movieId"),
        "solved": known_solve_sql("rated", "userId", _rank),
    }, _flat_sql("solved", "userId", _rank)))
    def f9_fold_in_users(spark, sf, rank=_rank):
        items = v.film_factors(spark, sf, rank).select("id", "features")
        return _flat5(foldin.fold_in_users(v.ratings(spark, sf), items, rank, ITERS, REG)[0])

    @query(f"f12_fold_in_items_rank{_rank}", v.with_views(["ratings", "customers"], {
        "rated": _rows_sql("ratings", "customers", "userId"),
        "solved": known_solve_sql("rated", "movieId", _rank),
    }, _flat_sql("solved", "movieId", _rank)))
    def f12_fold_in_items(spark, sf, rank=_rank):
        users = v.customer_factors(spark, sf, rank).select("id", "features")
        return _flat5(foldin.fold_in_items(v.ratings(spark, sf), users, rank, ITERS, REG))


_KNOWN_FILMS = "SELECT * FROM films WHERE p_type <> 'PROMO'"
_KNOWN_USERS = f"SELECT * FROM customers WHERE c_mktsegment <> '{v.TEST_SEGMENT}'"


@query("f9_fold_in_users_mixed", v.with_views(["ratings", "films"], {
    "known": _KNOWN_FILMS,
    "rated": _rows_sql("ratings", "known", "movieId"),
    **mixed_solve_steps("u", "rated", "userId"),
}, "SELECT userId AS id, CAST(1 AS BIGINT) AS pos, ROUND(CAST(CAST(w AS FLOAT) AS DOUBLE), 5) AS value FROM u_done"))
def f9_fold_in_users_mixed(spark, sf):
    items = v.known_film_factors(spark, sf, 1)
    return _flat5(foldin.fold_in_users(v.ratings(spark, sf), items, 1, ITERS, REG)[0])


@query("f9_proposed_factors", v.with_views(["ratings", "films"], {
    "known": _KNOWN_FILMS,
    "rated": _rows_sql("ratings", "known", "movieId"),
    **mixed_solve_steps("u", "rated", "userId"),
}, """
    SELECT movieId AS id, CAST(1 AS BIGINT) AS pos, ROUND(CAST(CAST(AVG(CAST(CAST(b * d AS FLOAT) AS DOUBLE)) AS FLOAT) AS DOUBLE), 5) AS value
    FROM rated JOIN u_done USING (userId) WHERE a1 IS NULL GROUP BY movieId"""))
def f9_proposed_factors(spark, sf):
    items = v.known_film_factors(spark, sf, 1)
    _, proposed = foldin.fold_in_users(v.ratings(spark, sf), items, 1, ITERS, REG)
    return _flat5(fa.average_factors(proposed, 1))


@query("f10_average_factors", """
    SELECT label AS id, i AS pos,
           ROUND(CAST(CAST(AVG(CAST(embedding[i] AS DOUBLE)) AS FLOAT) AS DOUBLE), 5) AS value
    FROM embeddings, (SELECT UNNEST(range(1, 65)) AS i) GROUP BY 1, 2""")
def f10_average_factors(spark, sf):
    proposed = v.table(spark, sf, "embeddings").select(
        F.col("label").alias("id"), F.col("embedding").alias("features")
    )
    return _flat5(fa.average_factors(proposed, 64))


@query("f11_merge_factors", v.with_views(["first_half", "second_half"], {
    "merged": """
        SELECT COALESCE(o.id, n.id) AS id, COALESCE(n.features, o.features) AS features
        FROM (SELECT * FROM first_half WHERE label <= 6) o
        FULL JOIN (SELECT * FROM second_half WHERE label >= 4) n ON o.id = n.id""",
}, """
    SELECT id, i AS pos, ROUND(CAST(features[i] AS DOUBLE), 6) AS value
    FROM merged, (SELECT UNNEST(range(1, 33)) AS i)"""))
def f11_merge_factors(spark, sf):
    old = v.vectors(spark, sf, 0).filter(F.col("label") <= 6)
    new = v.vectors(spark, sf, 1).filter(F.col("label") >= 4)
    return flat(fa.merge_factors(old, new))


@query("f12_fold_in_items_mixed", v.with_views(["ratings", "customers"], {
    "known": _KNOWN_USERS,
    "rated": _rows_sql("ratings", "known", "userId"),
    **mixed_solve_steps("m", "rated", "movieId"),
}, "SELECT movieId AS id, CAST(1 AS BIGINT) AS pos, ROUND(CAST(CAST(w AS FLOAT) AS DOUBLE), 5) AS value FROM m_done"))
def f12_fold_in_items_mixed(spark, sf):
    users = v.known_customer_factors(spark, sf, 1)
    return _flat5(foldin.fold_in_items(v.ratings(spark, sf), users, 1, ITERS, REG))


@query("f13_merge_predictions", v.with_views(["base", "batch"], {}, _UPSERTED.replace(
    "AS rating", "AS predictedRating").replace(
    ",\n           CASE WHEN b.userId IS NOT NULL THEN true END AS full_train", "")))
def f13_merge_predictions(spark, sf):
    old = v.base(spark, sf).drop("full_train").withColumnRenamed("rating", "predictedRating")
    new = v.batch(spark, sf).withColumnRenamed("rating", "predictedRating")
    return fa.merge_predictions(old, new)


def _model(spark, sf) -> Model:
    """Rank-1 factors for the films that are not promotional and the customers
    outside the test segment; the kept lines as trained ratings."""
    users = v.known_customer_factors(spark, sf, 1)
    items = v.known_film_factors(spark, sf, 1)
    params = Params(rank=1, iters=ITERS, reg=REG)
    ratings = cut(v.base(spark, sf))  # read several times by an update
    return Model(params, users, items, ratings, no_ids(users), no_ids(items))


def _applied(changed: str) -> dict[str, str]:
    """The whole update at rank 1, with ``changed`` as the ratings after it."""
    return {
        "upserted": changed,
        "known_items": _KNOWN_FILMS,
        "known_users": _KNOWN_USERS,
        "user_rows": _touched_sql("userId"),
        "item_rows": _touched_sql("movieId"),
        "urows": _rows_sql("user_rows", "known_items", "movieId"),
        **mixed_solve_steps("u", "urows", "userId"),
        "new_users": "SELECT userId AS id, CAST(CAST(w AS FLOAT) AS DOUBLE) AS f1, 0 AS f2 FROM u_done",
        "proposed": """
            SELECT movieId AS id, CAST(CAST(AVG(CAST(CAST(b * d AS FLOAT) AS DOUBLE)) AS FLOAT) AS DOUBLE) AS f1
            FROM urows JOIN u_done USING (userId) WHERE a1 IS NULL GROUP BY movieId""",
        "users_now": """
            SELECT id, f1, f2 FROM new_users UNION ALL
            SELECT id, f1, f2 FROM known_users WHERE id NOT IN (SELECT id FROM new_users)""",
        "items_now": """
            SELECT id, f1 FROM proposed UNION ALL
            SELECT id, f1 FROM known_items WHERE id NOT IN (SELECT id FROM proposed)""",
        "irows": _rows_sql("item_rows", "users_now", "userId"),
        **mixed_solve_steps("m", "irows", "movieId"),
        "new_items": "SELECT movieId AS id, CAST(CAST(w AS FLOAT) AS DOUBLE) AS f1 FROM m_done",
        "items_then": """
            SELECT id, f1 FROM new_items UNION ALL
            SELECT id, f1 FROM items_now WHERE id NOT IN (SELECT id FROM new_items)""",
    }


_UPDATED = """
    SELECT 'user' AS side, id, ROUND(f1, 4) AS value FROM users_now
    UNION ALL SELECT 'item', id, ROUND(f1, 4) FROM items_then
    UNION ALL SELECT 'updated user', id, 0 FROM new_users
    UNION ALL SELECT 'updated item', id, 0
    FROM (SELECT id FROM new_items UNION SELECT id FROM proposed)"""


@query("f14_apply_batch", v.with_views(["base", "batch", "films", "customers"], _applied(_UPSERTED), _UPDATED))
def f14_apply_batch(spark, sf):
    return _updated(apply_batch(_model(spark, sf), cut(v.batch(spark, sf))))


def _stored(spark, sf):
    """The same batch on a store of the ratings: (model, store) after it."""
    model = _model(spark, sf)
    store = RatingsStore.create(model.ratings, scratch(spark, "ratings"), buckets=16)
    return apply_to_store(model, store, cut(v.batch(spark, sf)))


@query("f14_apply_batch_stored", v.with_views(["base", "batch", "films", "customers"], _applied(_UPSERTED), _UPDATED))
def f14_apply_batch_stored(spark, sf):
    return _updated(_stored(spark, sf)[0])


@query("f14_stored_ratings", v.with_views(["base", "batch"], {}, _UPSERTED))
def f14_stored_ratings(spark, sf):
    """The store's rows after the batch, its delta merged with the whole part."""
    return _stored(spark, sf)[1].rows()


def _updated(model: Model):
    value = F.round(F.get("features", F.lit(0)).cast("double"), 4).alias("value")
    out = None
    for side, df in (("user", model.user_factors), ("item", model.item_factors)):
        one = df.select(F.lit(side).alias("side"), "id", value)
        out = one if out is None else out.unionByName(one)
    for side, df in (("updated user", model.updated_users), ("updated item", model.updated_items)):
        out = out.unionByName(df.select(F.lit(side).alias("side"), "id", F.lit(0.0).alias("value")))
    return out


def _after(spark, sf, kind):
    """Factors after owning or removing the returned films."""
    pairs = cut(v.batch(spark, sf).select("userId", "movieId"))
    model = apply_batch(_model(spark, sf), pairs, kind)
    users = model.user_factors.withColumn("side", F.lit("user"))
    both = users.unionByName(model.item_factors.withColumn("side", F.lit("item")))
    value = F.round(F.get("features", F.lit(0)).cast("double"), 4)
    return both.select("side", "id", value.alias("value"))


_FACTORS_THEN = """
    SELECT 'user' AS side, id, ROUND(f1, 4) AS value FROM users_now
    UNION ALL SELECT 'item', id, ROUND(f1, 4) FROM items_then"""


@query("f14_own_batch", v.with_views(
    ["base", "batch", "films", "customers"], _applied(_OWNED), _FACTORS_THEN))
def f14_own_batch(spark, sf):
    return _after(spark, sf, "own")


@query("f14_remove_batch", v.with_views(
    ["base", "batch", "films", "customers"], _applied(_REMOVED), _FACTORS_THEN))
def f14_remove_batch(spark, sf):
    return _after(spark, sf, "remove")
