import time

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.operators import foldin, scoring
from reelspark.plans.incremental import apply_batch
from reelspark.plans.model import (
    Model,
    Params,
    fit,
    fit_implicit,
    implicit_labels,
    no_ids,
    predict,
    recommend,
)
from reelspark.plans.tuning import cross_validate_ratings, cross_validate_users, pivot_curves
from reelspark.recommender import Recommender
from reelspark.streaming import updates


def _factors(df):
    return {r.id: np.array(r.features) for r in df.collect()}


def _sample(users, films, share, seed):
    rng = np.random.default_rng(seed)
    return [(u, m, float(rng.integers(1, 11) / 2))
            for u in range(users) for m in range(films) if rng.random() < share]


def test_fit_solves_users_last(rate):
    rows = _sample(25, 15, 0.5, 1)
    model = fit(rate(rows), Params(rank=3, iters=4, reg=0.1))
    users, items = _factors(model.user_factors), _factors(model.item_factors)
    assert all((v >= 0).all() and len(v) == 3 for v in [*users.values(), *items.values()])
    for u, w in users.items():
        a = np.array([items[m] for x, m, _ in rows if x == u])
        b = np.array([r for x, _, r in rows if x == u])
        slope = a.T @ (a @ w - b) + 0.1 * len(b) * w
        assert (slope > -1e-3).all() and np.abs(slope * w).max() < 1e-2
    assert model.ratings.filter("full_train").count() == len(rows)
    again = fit(rate(rows), Params(rank=3, iters=4, reg=0.1))
    for u, w in _factors(again.user_factors).items():
        assert w == pytest.approx(users[u], abs=1e-4)


def test_fit_with_ids_beyond_int(rate):
    far = 5_000_000_000
    rows = [(u + far, m, r) for u, m, r in _sample(10, 8, 0.6, 2)]
    model = fit(rate(rows), Params(rank=2, iters=2))
    assert {r.id for r in model.user_factors.collect()} == {u for u, _, _ in rows}
    assert {r.id for r in model.item_factors.collect()} == {m for _, m, _ in rows}


def test_implicit(rate):
    rated = rate([(1, 1, 4.0), (1, 2, 3.5), (2, 1, 5.0)])
    assert sorted(r.rating for r in implicit_labels(rated).collect()) == [0, 1, 1]
    model = fit_implicit(rated, Params(rank=2, iters=2))
    assert model.user_factors.count() == 2


def test_predictions(spark, factors, rate):
    users, items = factors({1: (1, 2), 5: (0, 1)}), factors({10: (3, 4), 11: (1, 0), 12: (1, 0)})
    seen = rate([(1, 11, 3.0), (1, 99, 1.0), (7, 10, 1.0), (1, 11, 2.0)])
    everyone = spark.createDataFrame([(1,), (5,), (7,)], "userId bigint")
    got = {(r.userId, r.movieId): r.predictedRating
           for r in scoring.predict_unseen(users, items, seen, 2, everyone).collect()}
    assert got == {(1, 10): 11.0, (1, 12): 1.0, (5, 10): 4.0, (5, 11): 0.0, (5, 12): 0.0}
    model = Model(Params(rank=2), users, items, seen, no_ids(users), no_ids(items))
    asked = spark.createDataFrame([(5,), (7,), (8,)], "userId bigint")
    top = recommend(model, asked, 2).orderBy("position").collect()
    assert [(r.userId, r.movieId) for r in top] == [(5, 10), (5, 11)]
    assert predict(model, asked).count() == 3


def test_the_model_does_not_depend_on_the_cluster(spark, rate):
    rows = rate(_sample(40, 25, 0.5, 21))
    params = Params(rank=3, iters=3)
    few = _factors(fit(rows.repartition(2), params).user_factors)
    shown = spark.sparkContext.defaultParallelism
    try:
        type(spark.sparkContext).defaultParallelism = property(lambda _: 64)
        many = _factors(fit(rows.repartition(2), params).user_factors)
    finally:
        type(spark.sparkContext).defaultParallelism = property(lambda c: c._jsc.sc().defaultParallelism())
    assert spark.sparkContext.defaultParallelism == shown
    assert {k: list(x) for k, x in few.items()} == {k: list(x) for k, x in many.items()}
    other = _factors(fit(rows, Params(rank=3, iters=3, blocks=16)).user_factors)
    assert set(other) == set(few)


def test_ratings_without_factors_reach_no_cell(factors, rate):
    users, items = factors({1: (1, 0), 2: (0, 1)}), factors({1: (1, 1), 2: (2, 2)})
    rows = [(u, m, 1.0) for u in range(1, 40) for m in range(1, 40)] + [(1, 1, 2.0)] * 50
    top = scoring.recommend_top(users, items, rate(rows), 2, n=5)
    assert top.count() == 0


def test_ids_that_repeat_are_refused(spark, rate):
    twice = spark.createDataFrame([(1, [1.0, 0.0])] * 100, "id bigint, features array<float>")
    with pytest.raises(Exception, match="not unique"):
        scoring.recommend_top(twice, twice, rate([(5, 5, 1.0)]), 2, n=1, per_block=(2, 2)).collect()


def test_recommendations_over_many_blocks(factors, rate):
    rng = np.random.default_rng(3)
    u = {i: rng.integers(0, 3, 2) for i in range(20)}
    v = {i: rng.integers(0, 3, 2) for i in range(30)}
    rows = _sample(20, 30, 0.3, 5)
    seen = {(a, b) for a, b, _ in rows}
    got = {}
    for r in scoring.recommend_top(factors(u), factors(v), rate(rows), 2, n=5, per_block=(3, 4)).collect():
        got.setdefault(r.userId, {})[r.position] = (r.movieId, r.predictedRating)
    for a, w in u.items():
        best = sorted((-float(w @ x), m) for m, x in v.items() if (a, m) not in seen)[:5]
        assert got[a] == {i + 1: (m, -s) for i, (s, m) in enumerate(best)}


def test_blocks_that_cannot_reach_the_best_are_left_out(factors, rate, tmp_path):
    """Films of small norm are scored for no user, and the answer is that of scoring all."""
    rng = np.random.default_rng(4)
    u = {i: rng.uniform(0.5, 1, 3) for i in range(40)}
    v = {i: rng.uniform(0.5, 1, 3) * 0.97**i for i in range(300)}
    rows = [(a, m, 1.0) for a in range(40) for m in range(a % 7)]
    seen = {(a, b) for a, b, _ in rows}

    def log(group):
        with open(tmp_path / f"{group.ids[0]}", "w") as f:
            f.write(f"{group.scored} {group.skipped} {len(group.ids)}")

    top = scoring.recommend_top(factors(u), factors(v), rate(rows), 3, n=4, per_block=(10, 20), log=log)
    got = {}
    for r in top.collect():
        got.setdefault(r.userId, []).append((r.position, r.movieId))
    for a, w in u.items():
        best = sorted((-np.float32(w.astype("f4").astype(float) @ x.astype("f4").astype(float)), m)
                      for m, x in v.items() if (a, m) not in seen)[:4]
        assert sorted(got[a]) == [(i + 1, m) for i, (_, m) in enumerate(best)]
    scored, skipped, users = np.array([p.read_text().split() for p in tmp_path.iterdir()], int).sum(axis=0)
    assert users == 40 and skipped > 2 * scored


def test_one_side_of_the_scores_is_replicated(factors, rate):
    top = scoring.recommend_top(factors({1: (1, 1), 2: (1, 2)}), factors({1: (1, 1)}), rate([(1, 1, 1.0)]), 2, n=1, per_block=(1, 1))
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(") == 1
    assert "Aggregate" not in plan and "Window" not in plan and "collect_list" not in plan


@pytest.mark.parametrize("rank, min_rows", [(1, None), (2, 4), (3, 100_000), (2, 1)])
def test_fold_in(factors, rate, rank, min_rows):
    """Splitting an entity's rows over tasks does not change its solve."""
    rng = np.random.default_rng(rank)
    items = {m: rng.uniform(0, 2, rank) for m in range(15)}
    rows = _sample(12, 20, 0.5, 6)
    users, proposed = foldin.fold_in_users(rate(rows), factors(items), rank, 3, 0.1, min_rows)
    got = _factors(users)
    proposals = {}
    for u in {r[0] for r in rows}:
        mine = [(m, r) for x, m, r in rows if x == u]
        w, found = brute.solve([items.get(m) for m, _ in mine], [r for _, r in mine], rank, 3, 0.1)
        assert got[u] == pytest.approx(w, abs=1e-4)
        for i, vector in found.items():
            proposals.setdefault(mine[i][0], []).append(vector)
    assert set(proposals) == set(range(15, 20))
    for r in proposed.collect():
        assert any(r.features == pytest.approx(x, abs=1e-4) for x in proposals[r.id])
    assert proposed.count() == sum(map(len, proposals.values()))


def test_fold_in_items(factors, rate):
    rng = np.random.default_rng(8)
    users = {u: rng.uniform(0, 2, 2) for u in range(9)}
    rows = _sample(12, 6, 0.7, 7)
    got = _factors(foldin.fold_in_items(rate(rows), factors(users), 2, 3, 0.1))
    for m in {r[1] for r in rows}:
        mine = [(u, r) for u, x, r in rows if x == m]
        w, _ = brute.solve([users.get(u) for u, _ in mine], [r for _, r in mine], 2, 3, 0.1)
        assert got[m] == pytest.approx(w, abs=1e-4)


@pytest.fixture
def model(factors, rate):
    rng = np.random.default_rng(11)
    users = factors({u: rng.uniform(0, 2, 2) for u in range(5)})
    items = factors({m: rng.uniform(0, 2, 2) for m in range(6)})
    rows = _sample(5, 6, 0.8, 12)
    return Model(Params(rank=2, iters=3), users, items, rate(rows, True),
                 no_ids(users), no_ids(items))


def test_a_batch_touches_only_its_users_and_films(model, rate):
    before = _factors(model.user_factors)
    after = apply_batch(model, rate([(0, 1, 5.0), (9, 20, 4.0)]))
    users = _factors(after.user_factors)
    assert set(users) == {*before, 9}
    assert all(users[u] == pytest.approx(before[u]) for u in (1, 2, 3, 4))
    assert 20 in _factors(after.item_factors)
    assert {r.id for r in after.updated_users.collect()} == {0, 9}
    assert {r.id for r in after.updated_items.collect()} == {1, 20}


def test_a_user_without_ratings_keeps_the_factors(model):
    pairs = model.ratings.filter("userId = 3").select("userId", "movieId")
    after = apply_batch(model, pairs, "remove")
    assert after.ratings.filter("userId = 3").count() == 0
    assert _factors(after.user_factors)[3] == pytest.approx(_factors(model.user_factors)[3])
    assert after.updated_users.count() == 0


def test_owned_films(model, spark):
    pairs = spark.createDataFrame([(0, 5), (8, 5)], "userId bigint, movieId bigint")
    after = apply_batch(model, pairs, "own")
    assert {r.rating for r in after.ratings.filter("userId = 8").collect()} == {4.0}
    assert 8 in _factors(after.user_factors)


def test_recommender(spark, rate, tmp_path):
    names = {"userId": "u", "movieId": "m", "rating": "r"}
    rated = rate(_sample(12, 10, 0.7, 15)).withColumnsRenamed(names)
    r = Recommender("u", "m", "r", update_threshold=30, rank=2, maxIter=2)
    with pytest.raises(ValueError):
        r.recommend()
    r.fit(rated)
    one = spark.createDataFrame([(3,)], "u bigint")
    assert r.recommend(one, 2).columns == ["u", "m", "predictedRating", "position"]
    r.add_ratings(spark.createDataFrame([(50, 1, 4.5)], "u bigint, m bigint, r float"))
    new = spark.createDataFrame([(50,)], "u bigint")
    assert r.recommend(new, 3).count() == 3
    assert r.predict(new).count() == 9
    r.add_to_collection(spark.createDataFrame([(50, 2)], "u bigint, m bigint"))
    r.remove_ratings(spark.createDataFrame([(50, 1)], "u bigint, m bigint"))
    assert [tuple(x)[:3] for x in r.model.ratings.filter("userId = 50").collect()] == [(50, 2, 4.0)]
    r.save(str(tmp_path / "m"), save_ratings=True)
    again = Recommender().load(spark, str(tmp_path / "m"))
    assert again.params == r.params
    assert again.recommend(new, 3).collect() == r.recommend(new, 3).collect()
    unseen = rate(_sample(30, 10, 1.0, 16)).filter("userId > 20").withColumnsRenamed(names)
    assert again.evaluate(unseen).count() == 5
    assert again.evaluate_without_ratings(unseen).count() == 5
    r.save(str(tmp_path / "bare"))
    bare = Recommender().load(spark, str(tmp_path / "bare"))
    for x, y in zip(sorted(bare.evaluate(unseen).collect()), sorted(r.evaluate(unseen).collect()), strict=True):
        assert x[:2] == y[:2] and tuple(x[2:]) == pytest.approx(tuple(y[2:]))
    assert again.fit().model.updated_users.count() == 0


def _same_model(got, want):
    for one, other in ((got.user_factors, want.user_factors), (got.item_factors, want.item_factors)):
        one, other = _factors(one), _factors(other)
        assert set(one) == set(other)
        assert all(one[k] == pytest.approx(other[k], abs=1e-5) for k in other)
    assert sorted(map(str, got.ratings.collect())) == sorted(map(str, want.ratings.collect()))


def test_stream(model, rate, spark, tmp_path):
    root, source = str(tmp_path / "models"), str(tmp_path / "in")
    updates.start_model(model, root)
    batch = rate([(0, 1, 5.0), (9, 20, 4.0)])
    batch.coalesce(1).write.json(source)

    def drain(checkpoint):
        stream = spark.readStream.schema(batch.schema).json(source)
        query = updates.start_updates(stream, root, str(tmp_path / checkpoint), availableNow=True)
        assert query.awaitTermination(120)

    drain("one")
    want = apply_batch(model, batch)
    _same_model(updates.load_current(spark, root), want)
    size = sum(f.stat().st_size for f in (tmp_path / "models" / "version=1" / "ratings").glob("part*"))
    assert 0 < size < 400  # the batch's rows, not the table
    drain("one")  # nothing new
    assert set(updates.versions(spark, root)) == {0, 1}

    # A stream with a new checkpoint counts from 0 again; its batches still count.
    second = rate([(9, 21, 2.0), (1, 2, 1.0)])
    updates.apply_to_saved(root, stream="other")(second, 0)
    updates.apply_to_saved(root, stream="other")(second, 0)  # run again after a failure
    want = apply_batch(want, second)
    _same_model(updates.load_current(spark, root), want)
    assert set(updates.versions(spark, root)) == {0, 1, 2}

    gone = second.select("userId", "movieId")
    updates.apply_to_saved(root, "remove", stream="removals")(gone, 0)
    want = apply_batch(want, gone, "remove")
    _same_model(updates.load_current(spark, root), want)
    updates.compact(spark, root)
    _same_model(updates.load_current(spark, root), want)


def test_scratch_tables_end_with_their_scope(spark, rate):
    from pathlib import Path

    from reelspark.functions import lineage

    folder = Path(lineage.shared_dir(spark))
    before = set(folder.iterdir())
    with lineage.scratch_scope(spark):
        assert lineage.cut(rate([(1, 1, 1.0)])).count() == 1
        assert set(folder.iterdir()) > before
    assert set(folder.iterdir()) == before


def test_cross_validation_of_users(rate, spark):
    from pathlib import Path

    from reelspark.functions import lineage

    rows = _sample(24, 12, 0.9, 13)
    grid = [Params(rank=2, iters=2, reg=r) for r in (0.1, 1.0)]
    folder, cached = Path(lineage.shared_dir(spark)), set(spark.sparkContext._jsc.getPersistentRDDs())
    before = {x.name for x in folder.iterdir()}
    curves = cross_validate_users(rate(rows), grid, folds=2, most=4)
    left = [x.name for x in folder.iterdir() if x.name not in before and x.name.startswith(("step-", "kept-", "curve-"))]
    assert len(left) == 4 and all(n.startswith("curve-") for n in left)
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= cached
    assert {(r.setting, r.fold) for r in curves.collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert {r.j for r in curves.collect()} <= {1, 2, 3, 4}
    wide = pivot_curves(curves, 4)
    assert wide.columns[-4:] == ["rmse0", "rmse1", "rmse2", "rmse3"] and wide.count() == 4


def test_cross_validation_of_ratings(rate):
    rows = _sample(30, 12, 0.9, 14)
    got = cross_validate_ratings(rate(rows), {"regParam": [0.1], "rank": [2], "maxIter": [2]},
                                 folds=2, samples=[(10, 0), (20, 1)]).collect()
    assert [(r.num_users, r.user_group) for r in got] == [(10, 0), (20, 1)]
    assert all(r.train_users <= r.num_users and r.rmse > 0 for r in got)


def test_cross_validation_does_not_depend_on_partitions(rate):
    rated = rate(_sample(30, 12, 0.9, 14))
    grid = {"regParam": [0.1], "rank": [2], "maxIter": [2]}
    few, many = (cross_validate_ratings(rated.repartition(n), grid, folds=2).first() for n in (2, 5))
    assert few[:-1] == many[:-1] and few.rmse == pytest.approx(many.rmse, abs=1e-4)


def test_samples_of_few_users_share_films_between_folds(rate):
    """Users with neighbouring keys don't get a film's ratings into one fold."""
    from reelspark.functions.ordering import order_key
    from reelspark.plans.tuning import rating_fold

    users = rate([(u, 1, 1.0) for u in range(200_000)]).orderBy(order_key(9, F.col("userId"))).limit(40).select("userId")
    rated = rate([(r.userId, m, 1.0 + m % 5) for r in users.collect() for m in range(60)])
    folds = rated.groupBy("movieId").agg(F.countDistinct(rating_fold(2, 9)).alias("n"))
    assert folds.filter("n = 2").count() == 60
    got = cross_validate_ratings(rated, {"regParam": [0.1], "rank": [2], "maxIter": [2]}, folds=2, samples=[(40, 0)]).first()
    assert got.train_movies > 20 and 0 < got.rmse < 6


def test_folds_without_a_known_film_have_no_error(rate):
    got = cross_validate_ratings(rate([(u, u, 3.0) for u in range(30)]), {"regParam": [0.1], "rank": [2], "maxIter": [2]}, folds=2).first()
    assert got.train_ratings > 0 and got.rmse is None


def test_small_groups_of_users_make_no_more_copies_of_films(factors, rate):
    assert scoring.places_for(800_000, 64, 12) == scoring.places_for(800_000, 32_768, 12) == 24
    u, v = {i: (1, i % 7) for i in range(600)}, {i: (1, i % 5) for i in range(30)}
    many, few = (scoring.recommend_top(factors(u), factors(v), rate([(1, 1, 1.0)]), 2, n=3, per_block=(size, 8)) for size in (2, 600))
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
    assert many.rdd.getNumPartitions() <= scoring.LEAST_PLACES


def test_solver_blocks_are_no_more_than_the_ratings_need():
    from reelspark.plans.model import LEAST_BLOCKS, solver_blocks

    assert solver_blocks(3_600_000) == solver_blocks(36_000_000) == LEAST_BLOCKS and solver_blocks(400_000_001) == 21


def test_fit_blocks_are_as_small_as_a_task_needs():
    from reelspark.plans.model import LEAST_BLOCKS, MOST_PER_TASK, fit_blocks, solver_blocks

    assert fit_blocks(36_000_000) == solver_blocks(36_000_000) == LEAST_BLOCKS
    assert fit_blocks(216_000_000) == 44 and all(n / fit_blocks(n) <= MOST_PER_TASK for n in (1, 50_000_001, 10**10))


def test_a_fit_drops_the_shuffles_of_its_iterations(shuffles, rate):
    """While the model is in use, those of the last one and of the blocks of ratings may stay, whatever their number."""
    rated = rate([(u, m, float(1 + (u * m) % 5)) for u in range(30) for m in range(u % 3, 40, 3)])
    model = fit(rated, Params(rank=3, iters=9))
    until = time.time() + 10
    while time.time() < until and shuffles() > 8:
        time.sleep(0.2)
    assert shuffles() <= 8
    assert model.user_factors.count() == 30 and model.item_factors.count() == 40
