from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from reelspark.functions.ordering import MODULUS, order_key
from reelspark.functions.ranking import hot_keys, rank_all, rank_in_group, salted_join


def _key(seed, first, second=None):
    x = (first * 48271 + seed) % MODULUS * 69621
    if second is not None:
        x += second * 40692
    return x % 2147483399 * 16807 % MODULUS


@pytest.fixture
def skewed(spark):
    """One user holds two thirds of the rows."""
    rows = [(1, m) for m in range(400)] + [(u, m) for u in range(2, 42) for m in range(5)]
    return spark.createDataFrame(rows, "userId bigint, movieId bigint").withColumn(
        "key", order_key(9, F.col("userId"), F.col("movieId"))
    )


def test_order_key(skewed):
    for u, m, k in skewed.collect():
        assert k == _key(9, u, m)


@pytest.mark.parametrize("min_rows", [10, 100_000])
def test_rank_in_group(skewed, min_rows):
    got = rank_in_group(skewed, "userId", "key", "movieId", min_rows=min_rows)
    groups = defaultdict(list)
    for r in got.collect():
        groups[r.userId].append((r.key, r.movieId, r.rn, r.profile_size))
    assert len(groups) == 41
    for rows in groups.values():
        rows.sort()
        assert [r[2] for r in rows] == list(range(1, len(rows) + 1))
        assert {r[3] for r in rows} == {len(rows)}


def test_a_large_group_is_spread_over_slices(skewed):
    hot = hot_keys(skewed, "userId", 10).collect()
    assert [(h.userId, h.hot_rows, h.hot_slices) for h in hot] == [(1, 400, 40)]
    slices = skewed.filter("userId = 1").select(
        F.floor(F.col("key") * 40 / F.lit(MODULUS)).alias("s")).groupBy("s").count()
    assert slices.agg(F.max("count")).first()[0] < 40


def test_every_hot_key_is_split(spark):
    rows = spark.range(2_000).crossJoin(spark.range(6).toDF("m")).withColumnRenamed("id", "userId")
    hot = hot_keys(rows, "userId", 2)
    assert hot.count() == 2_000
    assert {r.hot_slices for r in hot.collect()} == {3}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("min_rows", [10, 100_000])
def test_salted_join(spark, skewed, how, min_rows):
    fact = skewed.select("userId", "movieId")
    dim = spark.createDataFrame([(u, f"name {u}") for u in range(1, 30)], "userId bigint, name string")
    hot = hot_keys(fact, "userId", min_rows)
    got = salted_join(fact, dim, "userId", "movieId", hot, how)
    want = fact.join(dim, "userId", how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_no_task_gets_a_whole_hot_key(spark, skewed):
    """After salting, the rows of the large user lie in several partitions."""
    fact = skewed.select("userId", "movieId")
    dim = fact.select("userId").distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = salted_join(fact, dim, "userId", "movieId", hot_keys(fact, "userId", 10))
        at = joined.filter("userId = 1").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(at) == 4 and max(r["count"] for r in at) < 200


def test_rank_all(spark):
    ids = spark.range(5000).withColumn("key", order_key(3, F.col("id")))
    rows = sorted((r.key, r.id, r.rn) for r in rank_all(ids, "key", "id").collect())
    assert [r[2] for r in rows] == list(range(1, 5001))


def test_two_seeds_order_differently(spark):
    ids = spark.range(1000)
    first = [r.id for r in ids.orderBy(order_key(1, F.col("id"))).collect()]
    second = [r.id for r in ids.orderBy(order_key(2, F.col("id"))).collect()]
    assert first != second
