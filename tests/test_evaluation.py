import math
import time

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.operators import curves as cu
from reelspark.operators import profiles as pr
from reelspark.operators.foldin import prefix_solve
from reelspark.plans import tuning
from reelspark.plans.evaluation import evaluate, evaluate_ownership
from reelspark.plans.model import Model, Params, no_ids


def _profile(user, size, unknown):
    """``size`` films, the first ``unknown`` of which nobody trained on."""
    return [(user, 1000 + user * 100 + i if i < unknown else i, 3.0) for i in range(size)]


@pytest.mark.parametrize("size, unknown, dropped", [
    (8, 3, True), (8, 2, False), (40, 15, True), (40, 14, False), (1, 0, True), (2, 0, True),
    (39, 14, True), (39, 13, False),
])
def test_obscurity(spark, rate, size, unknown, dropped):
    profiles = pr.build_profiles(rate(_profile(1, size, unknown)))
    items = spark.range(100).withColumnRenamed("id", "movieId")
    kept, gone = pr.filter_obscure(profiles, items, 20)
    assert gone.count() == (1 if dropped else 0)
    assert kept.count() == (0 if dropped else size)


@pytest.mark.parametrize("size, train", [(7, 4), (50, 20), (1, 1)])
def test_split(spark, rate, size, train):
    profiles = pr.build_profiles(rate(_profile(1, size, 0)))
    items = spark.range(size - 1).withColumnRenamed("id", "movieId")
    first, rest = pr.split_profiles(profiles, items, 20)
    assert first.count() == train
    assert {r.rn for r in first.collect()} == set(range(1, train + 1))
    assert all(r.movieId < size - 1 and r.rn > train for r in rest.collect())


def test_folds(spark, rate):
    folds = pr.user_folds(rate([(u, 1, 1.0) for u in range(10)]), 3)
    sizes = {r.fold: r["count"] for r in folds.groupBy("fold").count().collect()}
    assert sizes == {0: 3, 1: 3, 2: 3, None: 1}
    few = pr.user_folds(rate([(1, 1, 1.0)]), 3).collect()
    assert [r.fold for r in few] == [None]


def _elbow(spark, errors):
    rows = [("r", j + 1, float(e)) for j, e in enumerate(errors)]
    curve = spark.createDataFrame(rows, "run string, j int, rmse double")
    elbow = cu.elbow_index(curve, 0.9)
    return elbow.first().elbow, cu.adjusted_rmse(curve, elbow).first().adjusted


@pytest.mark.parametrize("errors, elbow, adjusted", [
    ([1.5, 1.2, 1.0, 0.95, 0.96], 3, 1.344),
    ([1.5, 0.9, 1.0, 0.95], 3, (1 + 2 / 4) * 0.95),
    ([1.0, 1.2], 2, 1.5 * 1.2),
    ([1.0], 1, 1.0),
])
def test_elbow(spark, errors, elbow, adjusted):
    got = _elbow(spark, errors)
    assert got[0] == elbow
    assert got[1] == pytest.approx(adjusted)


def test_no_curve_no_elbow(spark):
    empty = spark.createDataFrame([], "run string, j int, rmse double")
    assert cu.elbow_index(empty).count() == 0


def test_pooled_error(spark, rate, factors):
    solved = spark.createDataFrame(
        [(1, 1, [1.0]), (1, 2, [1.0])], "j int, userId bigint, features array<float>")
    items = factors({1: [1.0], 2: [1.0], 3: [1.0]})
    validation = rate([(1, 1, 2.0), (1, 2, 1.0 + math.sqrt(3)), (2, 3, 1.0 + math.sqrt(5))])
    curve = cu.score_prefixes(solved, validation, items, 1).collect()
    assert [(r.j, round(r.rmse, 5)) for r in curve] == [(1, 1.73205)]
    users = {r.userId: (round(r.sse, 4), r.validation_size)
             for r in cu.user_errors(solved, validation, items, 1).collect()}
    assert users == {1: (4.0, 2), 2: (5.0, 1)}


@pytest.mark.parametrize("rank, iters", [(1, 3), (2, 0), (3, 4)])
def test_prefixes_with_films_created_on_the_way(spark, factors, rank, iters):
    rng = np.random.default_rng(rank)
    items = {m: rng.uniform(0.1, 2, rank) for m in range(12)}
    train = {u: [(int(m), float(rng.integers(1, 11) / 2))
                 for m in rng.permutation(20)[: rng.integers(1, 8)]] for u in range(25)}
    rows = [(u, m, r, n + 1) for u, t in train.items() for n, (m, r) in enumerate(t)]
    frame = spark.createDataFrame(rows, "userId bigint, movieId bigint, rating float, rn bigint")
    got = prefix_solve(frame, factors(items), 7, rank, iters, 0.1).collect()
    want = brute.prefixes(train, items, rank, iters, 0.1, 7)
    assert {(r.j, r.userId) for r in got} == set(want)
    for r in got:
        assert r.features == pytest.approx(want[r.j, r.userId], abs=1e-4)


@pytest.fixture
def setting(spark, factors):
    rng = np.random.default_rng(4)
    items = factors({m: rng.uniform(0, 1.5, 2) for m in range(40)})
    truth = {u: rng.uniform(0, 1.5, 2) for u in range(30)}
    films = {r.id: np.array(r.features) for r in items.collect()}
    rows = [(u, m, float(np.clip(w @ films[m] + rng.normal(0, 0.1), 0.5, 5)))
            for u, w in truth.items() for m in rng.permutation(40)[:16].tolist()]
    schema = "userId bigint, movieId bigint, rating float"
    test = spark.createDataFrame(rows, schema)
    trained = spark.createDataFrame([(99, m, 3.0) for m in range(40)], schema).withColumn(
        "full_train", F.lit(True))
    model = Model(Params(rank=2, iters=3, threshold=6), items, items, trained,
                  no_ids(items), no_ids(items))
    return model, test


def test_protocol(setting):
    model, test = setting
    rows = evaluate(model, test).orderBy("j").collect()
    errors = [r.rmse for r in rows]
    assert [r.j for r in rows] == [1, 2, 3, 4, 5, 6]
    assert errors[-1] < errors[0]
    assert len({r.elbow for r in rows}) == 1
    assert rows[0].adjusted == pytest.approx((1 + (rows[0].elbow - 1) / 6) * errors[-1])
    assert [r.rmse for r in evaluate(model, test).orderBy("j").collect()] == pytest.approx(errors)


def test_ownership_protocol(setting):
    model, test = setting
    same = test.withColumn("rating", F.lit(4.0).cast("float"))
    a = [r.rmse for r in evaluate_ownership(model, test).orderBy("j").collect()]
    b = [r.rmse for r in evaluate(model, same).orderBy("j").collect()]
    assert a == pytest.approx(b)


def test_all_users_too_obscure(setting, rate):
    model, _ = setting
    assert evaluate(model, rate([(1, 500, 3.0), (1, 501, 3.0)])).count() == 0


def test_a_large_user_is_summed_in_slices(spark, factors, rate):
    rng = np.random.default_rng(31)
    items = factors({m: rng.uniform(0, 2, 3) for m in range(40)})
    rows = [(1, m, float(rng.integers(1, 6))) for m in range(40)] + [(2, m, 3.0) for m in range(3)]
    solved = spark.createDataFrame(
        [(j, u, [float(x) for x in rng.uniform(0, 1, 3)]) for u in (1, 2, 3) for j in (1, 2)],
        "j int, userId bigint, features array<float>")
    whole, sliced = (
        sorted(tuple(r) for r in cu.user_errors(solved, rate(rows), items, 3, n).collect()) for n in (1000, 5))
    assert [r[:2] for r in whole] == [(1, 1), (1, 2), (2, 1), (2, 2)]
    for a, b in zip(whole, sliced, strict=True):
        assert a[:2] == b[:2] and a[3] == b[3] and a[2] == pytest.approx(b[2])
    w = {(r.j, r.userId): np.array(r.features) for r in solved.collect()}
    v = {r.id: np.array(r.features) for r in items.collect()}
    for j, u, sse, n in whole:
        mine = [(m, r) for x, m, r in rows if x == u]
        assert n == len(mine) and sse == pytest.approx(sum((r - w[j, u] @ v[m]) ** 2 for m, r in mine), rel=1e-5)


def test_blocks_of_a_fit_follow_the_ratings():
    from reelspark.plans.model import LEAST_BLOCKS, blocks_for

    assert blocks_for(0) == blocks_for(5_000_000) == LEAST_BLOCKS and blocks_for(50_000_001) == 51


@pytest.mark.parametrize("by", ["users", "ratings"])
def test_cross_validation_drops_shuffles(shuffles, rate, by):
    """Each fit's shuffles are dropped when it is done, so the disk needed doesn't grow with the grid."""
    rated = rate([(u, m, float(1 + (u * m) % 5)) for u in range(40) for m in range(u % 2, 30, 2)])
    most = []

    class Counted(tuning.KnownError):
        def _evaluate(self, dataset):
            found = super()._evaluate(dataset)
            most.append(shuffles())
            return found

    if by == "users":
        grid = [Params(rank=2, iters=6, reg=r) for r in (0.1, 1.0)]
        got = tuning.cross_validate_users(rated, grid, folds=2, most=4)
        assert {(r.setting, r.fold) for r in got.collect()} == {(s, f) for s in (0, 1) for f in (0, 1)}
    else:
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(tuning, "KnownError", Counted)
            got = tuning.cross_validate_ratings(rated, {"regParam": [0.1, 0.5, 1.0], "maxIter": [12]}, folds=2)
        assert got.count() == 3 and len(most) == 6
        # Those of two fits, each its blocks of ratings and one iteration, not of twelve iterations of six fits.
        assert max(most) < 2 * 24
    until = time.time() + 10
    while time.time() < until and shuffles() > 24:
        time.sleep(0.2)
    assert shuffles() <= 24


def test_user_folds_take_ratings_without_a_user_to_train(spark, rate, monkeypatch):
    """Every rating is tested in its user's fold and trained on in the others; one without a fold in all."""
    seen = []
    monkeypatch.setattr(tuning, "fit", lambda train, params: seen.append(train) or Model(params, *[None] * 5))
    monkeypatch.setattr(Model, "train_items", lambda self: None)

    def curve(items, trained, test, params, most):
        rows = sorted(map(tuple, seen.pop().collect())), sorted(map(tuple, test.collect()))
        pairs.append(rows)
        return spark.createDataFrame([(1, 0.5)], "j int, rmse double")

    pairs = []
    monkeypatch.setattr(tuning, "error_curve", curve)
    rows = [(u, m, 3.0) for u in range(7) for m in range(3)] + [(1, 0, 3.0)]
    tuning.cross_validate_users(rate(rows), [Params()], folds=2)
    left = {r.userId for r in pr.user_folds(rate(rows), 2, 9).collect() if r.fold is None}
    assert len(pairs) == 2 and len(left) == 1
    for train, test in pairs:
        assert sorted(train + test) == sorted(rows) and not {r[0] for r in test} & ({r[0] for r in train} | left)
