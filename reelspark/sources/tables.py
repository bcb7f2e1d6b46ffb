"""Appending to keyed tables, and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The related tables and their keys (no key: duplicates allowed).
TABLE_KEYS = {
    "movies": ("movieId",),
    "links": ("movieId",),
    "genome_tags": ("tagId",),
    "genome_scores": ("movieId", "tagId"),
    "tags": (),
    "ratings": ("userId", "movieId"),
}


class KeyViolation(ValueError):
    """Rows that would break a declared key."""


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n) of the keys that occur more than once or hold a null."""
    has_null = F.lit(False)
    for k in keys:
        has_null = has_null | F.col(k).isNull()
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.col("n") > 1) | has_null)


def already_present(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``df`` whose key is in ``table``."""
    return df.join(table.select(*keys), list(keys), "left_semi")


def new_rows(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``df`` whose key is not in ``table``."""
    return df.join(table.select(*keys), list(keys), "left_anti")


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet table at ``path``, or None if nothing has been written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_table(
    df: DataFrame, path: str, keys: Sequence[str] = (), skip_present: bool = False
) -> None:
    """Append ``df`` to the parquet table at ``path``.

    Nothing is written if a key occurs twice in ``df``, is null or is already in
    the table; with ``skip_present`` rows already in the table are left out
    instead.
    """
    table = read_table(df.sparkSession, path)
    if keys:
        bad = key_violations(df, keys).limit(1).collect()
        if bad:
            raise KeyViolation(f"{path}: key {bad[0].asDict()}")
        if table is not None and skip_present:
            df = new_rows(df, table, keys)
        elif table is not None:
            bad = already_present(df, table, keys).select(*keys).limit(1).collect()
            if bad:
                raise KeyViolation(f"{path}: key {bad[0].asDict()} is already present")
    df.write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Write the given columns as CSV files with a header."""
    chosen = df if columns is None else df.select(*columns)
    chosen.write.option("header", True).option("escape", '"').mode("errorifexists").csv(path)
