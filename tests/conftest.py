import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def shuffles(spark):
    """How many of the shuffles made since the start of the test are still kept."""
    from reelspark.functions.lineage import forget

    def ids():
        kept = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
        return set(kept.keysIterator().mkString(",").split(","))

    forget(spark)
    before = ids()
    return lambda: len(ids() - before)


@pytest.fixture
def rate(spark):
    """Ratings from tuples."""

    def make(rows, flag=None):
        if flag is None:
            return spark.createDataFrame(rows, "userId bigint, movieId bigint, rating float")
        rows = [(*r, flag) if len(r) == 3 else r for r in rows]
        return spark.createDataFrame(
            rows, "userId bigint, movieId bigint, rating float, full_train boolean"
        )

    return make


@pytest.fixture
def factors(spark):
    """Factor table from a dict."""

    def make(vectors):
        rows = [(k, [float(x) for x in v]) for k, v in vectors.items()]
        return spark.createDataFrame(rows, "id bigint, features array<float>")

    return make
