import pytest

from reelspark.functions import lineage
from reelspark.operators.regression import (
    fit_interaction_ols,
    fit_line,
    predict_interaction,
    predict_total,
    rmse,
)
from reelspark.plans.model import Model, Params, no_ids
from reelspark.sources import readers, tables
from reelspark.sources.model_store import load_model, load_predictions, save_model


def _write(path, text):
    path.write_text(text)
    return str(path)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ratings(spark, tmp_path):
    path = _write(tmp_path / "r.csv", "userId,movieId,rating,timestamp\n1,2,3.5,99\n")
    assert _rows(readers.read_ratings(spark, path)) == [(1, 2, 3.5)]


@pytest.mark.parametrize("read, one, other", [
    (readers.read_ratings, "userId,movieId,rating\n1,2,3.0\n", "movieId,userId,rating\n20,10,4.0\n"),
    (readers.read_links, "movieId,imdbId\n1,0000002\n", "imdbId,movieId\n0000003,4\n"),
    (readers.read_tags, "userId,movieId,tag,timestamp\n1,2,a,3\n", "movieId,userId,tag,timestamp\n1,2,a,3\n"),
    (lambda s, p: readers.read_genome(s, p, p + "/tags"), "movieId,tagId,relevance\n1,2,0.5\n",
     "tagId,movieId,relevance\n1,2,0.5\n"),
])
def test_a_file_with_another_header_fails(spark, tmp_path, read, one, other):
    folder = tmp_path / "in"
    (folder / "tags").mkdir(parents=True)
    _write(folder / "tags" / "t.csv", "tagId,tag\n1,x\n")
    _write(folder / "a.csv", one)
    assert read(spark, str(folder)).count() == 1
    _write(folder / "b.csv", other)
    with pytest.raises(Exception, match="header"):
        read(spark, str(folder)).collect()


def test_movies(spark, tmp_path):
    head = "movieId,title,genres,year,rated,runtime,director,writer,actors,plot,language,country,awards,imdb_rating,imdb_votes\n"
    body = '1,"A, B",x|y,1999,N/A,1 min,D,W,"a, b","said ""no""\nand left",E,U,N/A,7.5,1234.0\n'
    r = readers.read_movies(spark, _write(tmp_path / "m.csv", head + body)).first()
    assert (r.title, r.rated, r.plot) == ("A, B", None, 'said "no"\nand left')
    assert (r.imdb_rating, r.imdb_votes) == (7.5, 1234)


def test_links_keep_zeros(spark, tmp_path):
    path = _write(tmp_path / "l.csv", "movieId,imdbId,tmdbId\n1,0114709,862\n")
    assert _rows(readers.read_links(spark, path)) == [(1, "tt0114709")]


def test_genome(spark, tmp_path):
    scores = _write(tmp_path / "s.csv", "movieId,tagId,relevance\n1,1,0.5\n1,2,0.25\n")
    tags = _write(tmp_path / "t.csv", "tagId,tag\n1,007\n")
    got = readers.read_genome(spark, scores, tags)
    assert {tuple(r) for r in got.collect()} == {(1, 1, "007", 0.5), (1, 2, None, 0.25)}


def test_append_respects_keys(spark, rate, tmp_path):
    path, keys = str(tmp_path / "t"), ["userId", "movieId"]
    tables.append_table(rate([(1, 1, 3.0)]), path, keys)
    with pytest.raises(tables.KeyViolation):
        tables.append_table(rate([(1, 1, 4.0)]), path, keys)
    with pytest.raises(tables.KeyViolation):
        tables.append_table(rate([(2, 1, 4.0), (2, 1, 5.0)]), path, keys)
    with pytest.raises(tables.KeyViolation):
        tables.append_table(rate([(None, 1, 4.0)]), path, keys)
    assert tables.read_table(spark, path).count() == 1
    tables.append_table(rate([(1, 1, 4.0), (2, 2, 4.0)]), path, keys, skip_present=True)
    assert _rows(tables.read_table(spark, path)) == [(1, 1, 3.0), (2, 2, 4.0)]


def test_export(spark, rate, tmp_path):
    path = str(tmp_path / "out")
    tables.export_csv(rate([(1, 2, 3.5)]), path, ["movieId", "rating"])
    got = spark.read.csv(path, header=True)
    assert got.columns == ["movieId", "rating"] and _rows(got) == [("2", "3.5")]


def test_model_folder(spark, rate, factors, tmp_path):
    users, items = factors({1: (0.1, 2)}), factors({2: (3, 4)})
    model = Model(Params(rank=2, iters=5, reg=0.3, ownership=3.5, als={"alpha": 2.0}), users, items,
                  rate([(1, 2, 3.0)], True), users.select("id"), no_ids(items))
    bare, full = str(tmp_path / "bare"), str(tmp_path / "full")
    save_model(model, bare)
    save_model(model, full, with_ratings=True,
               predictions=rate([(1, 2, 4.5)]).withColumnRenamed("rating", "predictedRating"))
    got = load_model(spark, bare)
    assert got.params == model.params
    assert _rows(got.user_factors) == _rows(users) and got.ratings.count() == 0
    assert got.updated_users.count() == 1 and got.updated_items.count() == 0
    assert _rows(load_model(spark, full).ratings) == [(1, 2, 3.0, True)]
    assert _rows(load_predictions(spark, full)) == [(1, 2, 4.5)]
    assert load_predictions(spark, bare).count() == 0


def test_refit_before_saving(spark, rate, factors, tmp_path):
    rows = [(u, m, 1.0 + (u + m) % 5) for u in range(6) for m in range(5)]
    model = Model(Params(rank=2, iters=2), factors({1: (0, 0)}), factors({1: (0, 0)}),
                  rate(rows, True), factors({1: (0, 0)}).select("id"), factors({}).select("id"))
    saved = save_model(model, str(tmp_path / "m"), refit=True)
    assert saved.user_factors.count() == 6 and saved.updated_users.count() == 0


def test_shared_folder_comes_from_the_session(spark):
    assert lineage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_rmse_leaves_out_the_unpredictable(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, None), (4.0, float("nan"))], "a double, b double")
    assert rmse(df, "a", "b").first().rmse == pytest.approx(2.0)


def test_least_squares(spark):
    rows = [(float(a), float(b), 2 + 3.0 * a - b + 0.5 * a * b) for a in range(5) for b in range(4)]
    log = spark.createDataFrame(rows, "size double, rank double, time double")
    fit = fit_interaction_ols(log, "time", "size", "rank")
    assert (fit.intercept, fit.a, fit.b, fit.c) == pytest.approx((2, 3, -1, 0.5))
    assert fit.r2 == pytest.approx(1)
    cases = spark.createDataFrame([(1.0, 2.0), (0.0, 9.0)], "size double, rank double")
    assert [r.predicted for r in predict_interaction(fit, cases).collect()] == pytest.approx([4, 0])
    assert predict_total(fit, cases).first().total == pytest.approx(4)
    line = fit_line(spark.createDataFrame([(1, 3.0), (2, 5.0)], "x int, y double"), "y", "x").first()
    assert (line.slope, line.intercept) == pytest.approx((2, 1))


def test_tasks_do_not_need_the_package(tmp_path):
    """Python workers started elsewhere run the kernels without importing them."""
    import subprocess
    import sys
    from pathlib import Path

    script = tmp_path / "job.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
from reelspark.operators.foldin import fold_in_users
rows = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0)], "userId bigint, movieId bigint, rating float")
items = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id bigint, features array<float>")
print(round(fold_in_users(rows, items, 1, 0, 0.1)[0].first().features[0], 4))
""")
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True,
                          text=True, timeout=300)
    assert done.stdout.strip().endswith("1.5686"), done.stderr[-2000:]
