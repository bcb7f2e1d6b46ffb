"""Queries for evaluation on unseen users, and tuning."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.functions.lineage import cut, scratch
from reelspark.operators import curves as cu
from reelspark.operators import profiles as pr
from reelspark.operators import regression as reg
from reelspark.operators.foldin import prefix_solve
from reelspark.plans.evaluation import error_curve, evaluate, evaluate_ownership
from reelspark.plans.model import Model, Params, no_ids
from reelspark.plans.tuning import cross_validate_ratings, cross_validate_users
from reelspark.recommender import Recommender
from reelspark.sources.model_store import save_model
from workload import views as v
from workload.factors import ITERS, REG
from workload.registry import query, r6

MOST = 20


def _profiles_sql(source: str, seed: int = 9) -> str:
    return f"""
        SELECT userId, movieId, rating,
               ROW_NUMBER() OVER (PARTITION BY userId
                   ORDER BY {v.order_key_sql(seed, 'userId', 'movieId')}, movieId) AS rn,
               COUNT(*) OVER (PARTITION BY userId) AS profile_size
        FROM {source}"""


@query("v1_build_profiles", v.with_views(["ratings"], {}, _profiles_sql("ratings")))
def v1_build_profiles(spark, sf):
    return pr.build_profiles(v.ratings(spark, sf), seed=9)


def _unseen(source: str, known: str = "true") -> dict[str, str]:
    """Profiles of the test users, the films the training users rated, and the
    users whose profile is not too obscure."""
    return {
        "test": f"SELECT * FROM {source} WHERE userId IN (SELECT userId FROM test_users)",
        "train_items": f"SELECT DISTINCT movieId FROM {source} "
                       f"WHERE userId NOT IN (SELECT userId FROM test_users) AND {known}",
        "profiles": _profiles_sql("test"),
        "obscurity": """
            SELECT userId, ANY_VALUE(profile_size) AS size,
                   COUNT(*) FILTER (movieId NOT IN (SELECT movieId FROM train_items)) AS unknown
            FROM profiles GROUP BY userId""",
        "kept_users": f"""
            SELECT userId FROM obscurity
            WHERE CASE WHEN size >= 40 THEN unknown < size - {5 * MOST / 4}
                       ELSE unknown < FLOOR(size * 3 / 8) END""",
        "kept": "SELECT * FROM profiles WHERE userId IN (SELECT userId FROM kept_users)",
        "train": f"SELECT * FROM kept WHERE rn <= LEAST(CEIL(profile_size / 2), {MOST})",
        "validation": f"""
            SELECT * FROM kept WHERE rn > LEAST(CEIL(profile_size / 2), {MOST})
            AND movieId IN (SELECT movieId FROM train_items)""",
    }


def _parts(spark, sf, rated):
    """(test ratings, ids of the films the other users rated)."""
    users = v.test_users(spark, sf)
    test = rated.join(users, "userId", "left_semi")
    items = rated.join(users, "userId", "left_anti").select("movieId").distinct()
    return test, items


# Films of some types count as unknown to the fit, whoever has rated them.
_UNKNOWN_TYPES = ("PROMO", "SMALL")
_KNOWN = f"movieId // 10 IN (SELECT p_partkey FROM part WHERE p_type NOT IN {_UNKNOWN_TYPES})"


def _fine(spark, sf):
    rated = v.fine_ratings(spark, sf)
    test = rated.join(v.test_users(spark, sf), "userId", "left_semi")
    known = v.table(spark, sf, "part").filter(~F.col("p_type").isin(*_UNKNOWN_TYPES))
    train = rated.join(v.test_users(spark, sf), "userId", "left_anti")
    items = train.join(known, F.floor(F.col("movieId") / 10) == F.col("p_partkey"), "left_semi")
    items = items.select("movieId").distinct()
    return pr.filter_obscure(pr.build_profiles(test, 9), items, MOST), items


@query("v2_filter_obscure", v.with_views(["fine_ratings", "test_users"], _unseen("fine_ratings", _KNOWN),
                                         "SELECT * FROM kept"))
def v2_filter_obscure(spark, sf):
    return _fine(spark, sf)[0][0]


@query("v2_obscure_users", v.with_views(["fine_ratings", "test_users"], _unseen("fine_ratings", _KNOWN), """
    SELECT userId FROM obscurity WHERE userId NOT IN (SELECT userId FROM kept_users)"""))
def v2_obscure_users(spark, sf):
    return _fine(spark, sf)[0][1]


@query("v3_split_profiles", v.with_views(["fine_ratings", "test_users"], _unseen("fine_ratings", _KNOWN), """
    SELECT 'train' AS part, userId, movieId, rating, rn FROM train
    UNION ALL SELECT 'validation', userId, movieId, rating, rn FROM validation"""))
def v3_split_profiles(spark, sf):
    (kept, _), items = _fine(spark, sf)
    train, validation = pr.split_profiles(kept, items, MOST)
    out = train.withColumn("part", F.lit("train")).unionByName(
        validation.withColumn("part", F.lit("validation")))
    return out.select("part", "userId", "movieId", "rating", "rn")


_SUMS = """
    SELECT t.userId, CAST(t.rn AS INTEGER) AS j,
           SUM(f1 * rating) OVER w AS c1, SUM(f2 * rating) OVER w AS c2,
           SUM(f1 * f1) OVER w + 0.1 AS g11, SUM(f2 * f2) OVER w + 0.1 AS g22,
           SUM(f1 * f2) OVER w AS g12
    FROM train t JOIN films ON id = movieId
    WINDOW w AS (PARTITION BY t.userId ORDER BY t.rn)"""
_SOLVED = {
    1: {"sums": _SUMS, "solved": """
        SELECT j, userId, CAST(CAST(GREATEST(0, c1) / g11 AS FLOAT) AS DOUBLE) AS w1, 0 AS w2
        FROM sums"""},
    2: {"sums": _SUMS, "free": """
        SELECT *, (c1 * g22 - c2 * g12) / (g11 * g22 - g12 * g12) AS u1,
               (c2 * g11 - c1 * g12) / (g11 * g22 - g12 * g12) AS u2 FROM sums""",
        "solved": """
        SELECT j, userId,
               CAST(CAST(CASE WHEN u1 < 0 THEN 0 WHEN u2 < 0 THEN GREATEST(0, c1 / g11) ELSE u1 END
                    AS FLOAT) AS DOUBLE) AS w1,
               CAST(CAST(CASE WHEN u2 < 0 THEN 0 WHEN u1 < 0 THEN GREATEST(0, c2 / g22) ELSE u2 END
                    AS FLOAT) AS DOUBLE) AS w2
        FROM free"""},
}


def _split(spark, sf):
    test, items = _parts(spark, sf, v.ratings(spark, sf))
    kept, _ = pr.filter_obscure(pr.build_profiles(test, 9), items, MOST)
    return pr.split_profiles(kept, items, MOST)


for _rank in (1, 2):

    @query(f"v4_prefix_solve_rank{_rank}", v.with_views(
        ["ratings", "test_users", "films"], {**_unseen("ratings"), **_SOLVED[_rank]},
        " UNION ALL ".join(f"SELECT j, userId, {i} AS pos, ROUND(w{i}, 5) AS value FROM solved"
                           for i in range(1, _rank + 1))))
    def v4_prefix_solve(spark, sf, rank=_rank):
        train, _ = _split(spark, sf)
        items = v.film_factors(spark, sf, rank).select("id", "features")
        solved = prefix_solve(train, items, MOST, rank, ITERS, REG)
        return solved.select("j", "userId", F.posexplode("features").alias("p", "x")).select(
            "j", "userId", (F.col("p") + 1).alias("pos"),
            F.round(F.col("x").cast("double"), 5).alias("value"))


def _created_sql() -> dict[str, str]:
    """Rank-1 factors of the films the training users have not rated, step by
    step, then all prefix solves."""
    steps = {
        "factors": "SELECT movieId, f1 FROM train_items JOIN films ON id = movieId // 10",
        "first_seen": "SELECT movieId, MIN(rn) AS step FROM train "
                      "WHERE movieId NOT IN (SELECT movieId FROM train_items) GROUP BY movieId",
        "marked": """
            SELECT t.userId, t.movieId, t.rn, CAST(t.rating AS DOUBLE) AS b, f.f1,
                   COALESCE(s.step = t.rn, false) AS fresh
            FROM train t LEFT JOIN factors f USING (movieId) LEFT JOIN first_seen s USING (movieId)""",
        "made0": "SELECT CAST(NULL AS BIGINT) AS movieId, CAST(NULL AS DOUBLE) AS v WHERE false",
    }
    for j in range(1, MOST + 1):
        solve = f"SELECT *, (c + b * SQRT(b)) / (g + b + {REG}) AS w FROM sums"
        for _ in range(ITERS - 1):
            solve = (f"SELECT * REPLACE ((c + b * b * d) / (g + {REG} + b * b * d * d) AS w) "
                     f"FROM (SELECT userId, movieId, b, g, c, w, w / (w * w + {REG}) AS d FROM ({solve}))")
        steps[f"made{j}"] = f"""
            WITH sums AS (
                SELECT m.userId, m.movieId, m.b, COALESCE(SUM(r.a * r.a), 0) AS g,
                       COALESCE(SUM(r.a * r.b), 0) AS c
                FROM marked m LEFT JOIN (
                    SELECT userId, rn, b, COALESCE(f1, v) AS a
                    FROM marked LEFT JOIN made{j - 1} USING (movieId) WHERE rn < {j}
                ) r ON r.userId = m.userId
                WHERE m.fresh AND m.rn = {j} GROUP BY ALL)
            SELECT * FROM made{j - 1} UNION ALL
            SELECT movieId, CAST(CAST(AVG(CAST(CAST(b * w / (w * w + {REG}) AS FLOAT) AS DOUBLE))
                                      AS FLOAT) AS DOUBLE) AS v
            FROM ({solve}) GROUP BY movieId"""
    last = f"SELECT *, (c + b * SQRT(b)) / (g + b + {REG}) AS w FROM whole"
    for _ in range(ITERS):
        last = (f"SELECT * REPLACE ((c + b * b * d) / (g + {REG} + b * b * d * d) AS w) "
                f"FROM (SELECT userId, rn, b, g, c, fresh, gi, ci, w, w / (w * w + {REG}) AS d FROM ({last}))")
    steps["whole"] = f"""
        SELECT userId, rn, b, fresh, SUM(a * a) OVER w AS gi, SUM(a * b) OVER w AS ci,
               COALESCE(SUM(a * a) OVER e, 0) AS g, COALESCE(SUM(a * b) OVER e, 0) AS c
        FROM (SELECT userId, rn, b, fresh, COALESCE(f1, v) AS a
              FROM marked LEFT JOIN made{MOST} USING (movieId))
        WINDOW w AS (PARTITION BY userId ORDER BY rn),
               e AS (PARTITION BY userId ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
    steps["solved"] = f"""
        SELECT CAST(rn AS INTEGER) AS j, userId,
               CASE WHEN fresh THEN w ELSE ci / (gi + {REG}) END AS w FROM ({last})"""
    return steps


@query("v4_prefix_solve_unknown_films", v.with_views(
    ["fine_ratings", "test_users", "films"],
    {**_unseen("fine_ratings", _KNOWN), **_created_sql()},
    "SELECT j, userId, ROUND(CAST(CAST(w AS FLOAT) AS DOUBLE), 4) AS value FROM solved"))
def v4_prefix_solve_unknown_films(spark, sf):
    """Films the training users have not rated get their factors on the way."""
    (kept, _), items = _fine(spark, sf)
    items = cut(items)
    train = cut(pr.split_profiles(kept, items, MOST)[0])
    parts = v.film_factors(spark, sf, 1).select(F.col("id").alias("part"), "features")
    films = items.withColumn("part", F.floor(F.col("movieId") / 10))
    factors = films.join(parts, "part").select(F.col("movieId").alias("id"), "features")
    solved = prefix_solve(train, factors, MOST, 1, ITERS, REG)
    value = F.round(F.get("features", F.lit(0)).cast("double"), 4)
    return solved.select("j", "userId", value.alias("value"))


def curve_sql(rank: int) -> dict[str, str]:
    return {
        **_SOLVED[rank],
        "errors": """
            SELECT s.j, s.userId, POWER(CAST(rating AS DOUBLE) - (w1 * f1 + w2 * f2), 2) AS se
            FROM validation va JOIN films f ON f.id = va.movieId JOIN solved s ON s.userId = va.userId""",
        "curve": "SELECT j, SQRT(SUM(se) / COUNT(*)) AS rmse FROM errors GROUP BY j",
    }


@query("v5_user_errors", v.with_views(["ratings", "test_users", "films"],
                                      {**_unseen("ratings"), **curve_sql(2)}, """
    SELECT j, userId, ROUND(SUM(se), 4) AS sse, COUNT(*) AS validation_size
    FROM errors GROUP BY j, userId"""))
def v5_user_errors(spark, sf):
    train, validation = _split(spark, sf)
    items = v.film_factors(spark, sf, 2).select("id", "features")
    solved = prefix_solve(train, items, MOST, 2, ITERS, REG)
    scored = cu.user_errors(solved, validation, items, 2)
    return scored.withColumn("sse", F.round("sse", 4))


@query("v5_score_prefixes", v.with_views(["ratings", "test_users", "films"],
                                         {**_unseen("ratings"), **curve_sql(2)}, """
    SELECT j, ROUND(rmse, 5) AS rmse FROM curve"""))
def v5_score_prefixes(spark, sf):
    test, items = _parts(spark, sf, v.ratings(spark, sf))
    factors = v.film_factors(spark, sf, 2).select("id", "features")
    curve = error_curve(factors, items, test, Params(rank=2, iters=ITERS, reg=REG), MOST)
    return curve.withColumn("rmse", F.round("rmse", 5))


def elbow_sql(curves: str) -> dict[str, str]:
    return {
        "ordered": f"""
            SELECT run, rmse, ROW_NUMBER() OVER (PARTITION BY run ORDER BY j) AS pos,
                   COUNT(*) OVER (PARTITION BY run) AS points
            FROM {curves}""",
        "marked": """
            SELECT *, FIRST(rmse) OVER w AS f, LAST(rmse) OVER w AS l,
                   MAX(rmse) OVER (PARTITION BY run ORDER BY pos
                                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later
            FROM ordered WINDOW w AS (PARTITION BY run ORDER BY pos
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
        "elbows": """
            SELECT run, CAST(COALESCE(MIN(pos) FILTER (l <= f AND rmse >= later
                                                       AND f - rmse >= 0.9 * (f - l)),
                             MAX(points)) AS INTEGER) AS elbow
            FROM marked GROUP BY run""",
        "adjusted": """
            SELECT run, elbow, (1 + (elbow - 1) / points) * rmse AS adjusted
            FROM ordered JOIN elbows USING (run) WHERE pos = points""",
    }


@query("v6_elbow_index", v.with_views(["curves"], elbow_sql("curves"), "SELECT * FROM elbows"))
def v6_elbow_index(spark, sf):
    return cu.elbow_index(v.curves(spark, sf), 0.9)


@query("v7_adjusted_rmse", v.with_views(["curves"], elbow_sql("curves"), """
    SELECT run, elbow, ROUND(adjusted, 6) AS adjusted FROM adjusted"""))
def v7_adjusted_rmse(spark, sf):
    curves = v.curves(spark, sf)
    adjusted = cu.adjusted_rmse(curves, cu.elbow_index(curves, 0.9))
    return adjusted.withColumn("adjusted", r6("adjusted"))


def _protocol_sql(rating: str) -> str:
    steps = _unseen("rated")
    return v.with_views(["ratings", "test_users", "films"], {
        "rated": f"SELECT userId, movieId, {rating} AS rating FROM ratings",
        **steps, **curve_sql(2),
        "runs": "SELECT 'model' AS run, j, rmse FROM curve",
        **elbow_sql("runs"),
    }, """
        SELECT run, j, ROUND(rmse, 5) AS rmse, elbow, ROUND(adjusted, 5) AS adjusted
        FROM runs JOIN adjusted USING (run)""")


def _given(spark, sf):
    """A model with given factors, trained on all but the test users."""
    rated = v.ratings(spark, sf)
    users = v.test_users(spark, sf)
    train = rated.join(users, "userId", "left_anti").withColumn("full_train", F.lit(True))
    items = v.film_factors(spark, sf, 2).select("id", "features")
    model = Model(Params(rank=2, iters=ITERS, reg=REG), no_ids(items).withColumn("features", F.array().cast("array<float>")),
                  items, train, no_ids(items), no_ids(items))
    return model, rated.join(users, "userId", "left_semi")


def _r5(df):
    return df.withColumn("rmse", F.round("rmse", 5)).withColumn("adjusted", F.round("adjusted", 5))


@query("v8_evaluate", _protocol_sql("rating"))
def v8_evaluate(spark, sf):
    return _r5(evaluate(*_given(spark, sf)))


@query("s7_evaluate_loaded", _protocol_sql("rating"))
def s7_evaluate_loaded(spark, sf):
    """A model saved with the defaults, without ratings, under other column names."""
    model, test = _given(spark, sf)
    names = {"userId": "u", "movieId": "m", "rating": "r"}
    path = scratch(spark, "model")
    save_model(model, path, names=list(names.values()))
    return _r5(Recommender().load(spark, path).evaluate(test.withColumnsRenamed(names)))


@query("v9_evaluate_ownership", _protocol_sql("CAST(4.0 AS FLOAT)"))
def v9_evaluate_ownership(spark, sf):
    return _r5(evaluate_ownership(*_given(spark, sf)))


@query("t1_user_folds", v.with_views(["ratings"], {
    "ranked": f"""
        SELECT userId, ROW_NUMBER() OVER (ORDER BY {v.order_key_sql(9, 'userId')}, userId) AS rn,
               COUNT(*) OVER () AS users
        FROM (SELECT DISTINCT userId FROM ratings)""",
}, """
    SELECT userId, CAST(CASE WHEN (rn - 1) // (users // 7) < 7 THEN (rn - 1) // (users // 7) END
                        AS INTEGER) AS fold FROM ranked"""))
def t1_user_folds(spark, sf):
    return pr.user_folds(v.ratings(spark, sf), 7, 9)


def _folds_sql(folds: int) -> dict[str, str]:
    """The longest prefix that a test user of each fold is solved from."""
    return {
        "ranked": f"""
            SELECT userId, ROW_NUMBER() OVER (ORDER BY {v.order_key_sql(9, 'userId')}, userId) AS rn,
                   COUNT(*) OVER () AS users
            FROM (SELECT DISTINCT userId FROM ratings)""",
        "folds": f"SELECT userId, (rn - 1) // (users // {folds}) AS fold FROM ranked",
        "every": f"SELECT UNNEST(range(0, {folds})) AS fold",
        "known": "SELECT DISTINCT e.fold, r.movieId FROM every e, ratings r JOIN folds f USING (userId) "
                 "WHERE f.fold <> e.fold",
        "profiles": _profiles_sql("ratings"),
        "marked": f"""
            SELECT f.fold, p.*, k.movieId IS NULL AS fresh, LEAST(CEIL(profile_size / 2), {MOST}) AS nt
            FROM profiles p JOIN folds f USING (userId)
            LEFT JOIN known k ON k.fold = f.fold AND k.movieId = p.movieId""",
        "kept": f"""
            SELECT fold, userId, ANY_VALUE(nt) AS nt, COUNT(*) FILTER (rn > nt AND NOT fresh) AS validation
            FROM marked GROUP BY fold, userId
            HAVING CASE WHEN ANY_VALUE(profile_size) >= 40
                        THEN COUNT(*) FILTER (fresh) < ANY_VALUE(profile_size) - {5 * MOST / 4}
                        ELSE COUNT(*) FILTER (fresh) < FLOOR(ANY_VALUE(profile_size) * 3 / 8) END""",
        "reached": f"SELECT fold, MAX(nt) AS last FROM kept WHERE validation > 0 AND fold < {folds} GROUP BY fold",
    }


@query("t2_cross_validate_users", v.with_views(["ratings"], _folds_sql(2), """
    SELECT CAST(setting AS INTEGER) AS setting, 10 AS rank, 5 AS iters, reg, CAST(fold AS INTEGER) AS fold,
           CAST(last AS BIGINT) AS steps, CAST(last AS INTEGER) AS last, true AS plausible
    FROM reached, (VALUES (0, 0.1::DOUBLE), (1, 1.0::DOUBLE)) AS settings(setting, reg)"""))
def t2_cross_validate_users(spark, sf):
    """How far each fold's curve goes, and that its errors are between 0 and 3 stars."""
    grid = [Params(rank=10, iters=5, reg=r) for r in (0.1, 1.0)]
    rated = cut(v.ratings(spark, sf))  # read once per setting and fold
    curves = cross_validate_users(rated, grid, folds=2, most=MOST)
    keys = ["setting", "rank", "iters", "reg", "fold"]
    return curves.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("steps"), F.max("j").alias("last"),
        F.bool_and((F.col("rmse") > 0) & (F.col("rmse") < 3)).alias("plausible"))


_SHARE = 0.7


def _samples_sql(samples: list[tuple[int | None, int]]) -> str:
    """Ratings, users and films of the trained share of each sample."""
    parts = []
    for n, group in samples:
        users = "SELECT DISTINCT userId FROM ratings"
        if n is not None:
            key = v.order_key_sql(9 + group, "userId")
            users = f"SELECT userId FROM ({users}) ORDER BY {key}, userId LIMIT {n}"
        parts.append(f"""
            SELECT CAST({n or 'NULL'} AS BIGINT) AS num_users, {group} AS user_group,
                   COUNT(*) AS train_ratings, COUNT(DISTINCT userId) AS train_users,
                   COUNT(DISTINCT movieId) AS train_movies
            FROM ratings WHERE userId IN ({users})
            AND {v.order_key_sql(9, 'userId', 'movieId')} < {_SHARE} * 2147483647""")
    return v.with_views(["ratings"], {"samples": " UNION ALL ".join(parts)}, """
        SELECT samples.*, reg AS "regParam", CAST(10 AS BIGINT) AS rank, CAST(5 AS BIGINT) AS "maxIter",
               true AS plausible
        FROM samples, (VALUES (0.1::DOUBLE), (1.0::DOUBLE)) AS settings(reg)""")


def _cross_validated(spark, sf, samples):
    grid = {"regParam": [0.1, 1.0], "rank": [10], "maxIter": [5]}
    got = cross_validate_ratings(
        cut(v.ratings(spark, sf)), grid, folds=2, train_share=_SHARE, samples=samples)
    return got.withColumn("plausible", (F.col("rmse") > 0) & (F.col("rmse") < 6)).drop("rmse")


_SAMPLES = [(500, 0), (500, 1), (1000, 0)]


@query("t3_cross_validate_ratings", _samples_sql(_SAMPLES))
def t3_cross_validate_ratings(spark, sf):
    """Samples of users, which is what the operator is for."""
    return _cross_validated(spark, sf, _SAMPLES)


@query("t3_cross_validate_all", _samples_sql([(None, 0)]))
def t3_cross_validate_all(spark, sf):
    return _cross_validated(spark, sf, None)


@query("t4_rmse", v.with_views(["ratings", "films", "customers"], {}, """
    SELECT ROUND(SQRT(AVG(POWER(CAST(rating AS DOUBLE) - 5 * f.f1 * c.f2, 2))), 6) AS rmse
    FROM ratings r LEFT JOIN films f ON f.id = r.movieId AND p_type <> 'PROMO'
    LEFT JOIN customers c ON c.id = r.userId"""))
def t4_rmse(spark, sf):
    first, second = F.get("features", F.lit(0)).cast("double"), F.get("features", F.lit(1)).cast("double")
    films = v.known_film_factors(spark, sf, 1).select(F.col("id").alias("movieId"), first.alias("f1"))
    users = v.customer_factors(spark, sf, 2).select(F.col("id").alias("userId"), second.alias("f2"))
    rated = v.ratings(spark, sf).join(films, "movieId", "left").join(users, "userId", "left")
    rated = rated.withColumn("prediction", 5 * F.col("f1") * F.col("f2"))
    return reg.rmse(rated, "rating", "prediction").select(r6("rmse").alias("rmse"))


@query("t5_fit_line", """
    SELECT ROUND(REGR_SLOPE(lines, orders), 6) AS slope,
           ROUND(REGR_INTERCEPT(lines, orders), 6) AS intercept,
           ROUND(REGR_R2(lines, orders), 6) AS r2
    FROM (SELECT o_custkey, COUNT(DISTINCT o_orderkey) AS orders, COUNT(*) AS lines
          FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey)""")
def t5_fit_line(spark, sf):
    orders = v.table(spark, sf, "orders")
    lines = v.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n"))
    log = orders.join(lines, "o_orderkey").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("n").alias("lines"))
    fit = reg.fit_line(log, "lines", "orders")
    return fit.select(*[r6(c).alias(c) for c in ("slope", "intercept", "r2")])


_COV = {f"s{a}{b}": f"COVAR_POP({x}, {y})" for a, x in (("1", "x1"), ("2", "x2"), ("3", "x3"))
        for b, y in (("1", "x1"), ("2", "x2"), ("3", "x3"), ("y", "y"))}


def _det(rows: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = rows
    return f"({a}*({e}*{i}-{f}*{h}) - {b}*({d}*{i}-{f}*{g}) + {c}*({d}*{h}-{e}*{g}))"


def _cramer() -> list[str]:
    m = [[f"s{r}{c}" for c in "123"] for r in "123"]
    out = []
    for k in range(3):
        changed = [[f"s{r + 1}y" if c == k else m[r][c] for c in range(3)] for r in range(3)]
        out.append(f"{_det(changed)} / {_det(m)}")
    return out


_OLS = {
    "log": "SELECT l_quantity AS x1, l_discount AS x2, l_quantity * l_discount AS x3, "
           "l_extendedprice AS y FROM lineitem",
    "moments": "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _COV.items())
               + ", AVG(x1) AS m1, AVG(x2) AS m2, AVG(x3) AS m3, AVG(y) AS my FROM log",
    "slopes": "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in zip("abc", _cramer()))
              + " FROM moments",
    "fit": "SELECT a, b, c, my - a * m1 - b * m2 - c * m3 AS i FROM slopes",
}


def _interaction(spark, sf):
    return reg.fit_interaction_ols(
        v.table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", "l_discount")


@query("t5_fit_interaction", v.with_views([], _OLS, """
    SELECT ROUND(i, 3) AS intercept, ROUND(a, 3) AS a, ROUND(b, 3) AS b, ROUND(c, 3) AS c FROM fit"""))
def t5_fit_interaction(spark, sf):
    fit = _interaction(spark, sf)
    values = {"intercept": fit.intercept, "a": fit.a, "b": fit.b, "c": fit.c}
    return spark.createDataFrame([tuple(round(x, 3) for x in values.values())], list(values))


@query("t5_predict_total", v.with_views([], {
    **_OLS,
    "scenarios": "SELECT l_partkey, AVG(l_quantity) - 20 AS x1, AVG(l_discount) AS x2 "
                 "FROM lineitem GROUP BY l_partkey",
}, "SELECT ROUND(SUM(GREATEST(0, i + a * x1 + b * x2 + c * x1 * x2)), 0) AS total FROM scenarios, fit"))
def t5_predict_total(spark, sf):
    scenarios = v.table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        (F.avg("l_quantity") - 20).alias("l_quantity"), F.avg("l_discount").alias("l_discount"))
    total = reg.predict_total(_interaction(spark, sf), scenarios)
    return total.select(F.round("total", 0).alias("total"))
