"""A table with a key that is appended to in one step, and checked only where the key can be.

Every append is a part: its rows, dealt by ranges of the key, and an index with
the range of the key's first column in every file. An append compares its keys
with the files whose range meets its own, and takes effect when its manifest
appears; a writer that ends before leaves a part that no manifest names. Of two
writers one finds its number taken, reads the table again and checks again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions.lineage import cut, scratch_scope
from reelspark.sources import manifests
from reelspark.sources.tables import KeyViolation, already_present, key_violations, new_rows

#: How often an append starts again when other writers were first.
ATTEMPTS = 10


class KeyedTable:
    """The table at ``path`` with the given key; it need not exist yet."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        #: Files that the last append compared keys with, and files there were.
        self.compared, self.files = 0, 0

    def _manifest(self) -> tuple[int, list[str]]:
        found = manifests.latest(self.spark, self.path)
        return (-1, []) if found is None else (found[0], found[1]["parts"])

    def read(self) -> DataFrame | None:
        """The rows of all parts, None if nothing was appended yet."""
        _, parts = self._manifest()
        return self._rows(parts)

    def _rows(self, parts: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.path}/{p}/rows" for p in parts]) if parts else None

    def _may_hold(self, parts: list[str], rows: DataFrame) -> DataFrame | None:
        """The keys of the files that can hold keys of ``rows``."""
        first = self.keys[0]
        self.compared = self.files = 0
        if not parts:
            return None
        low, high = rows.agg(F.min(first), F.max(first)).first()
        index = self.spark.read.parquet(*[f"{self.path}/{p}/index" for p in parts])
        meets = (F.col("low") <= F.lit(high)) & (F.col("high") >= F.lit(low))
        self.files = index.count()
        names = [r.file for r in index.filter(meets).select("file").collect()]  # a name per file that is compared with
        self.compared = len(names)
        return self.spark.read.parquet(*names).select(*self.keys) if names else None

    def _write(self, rows: DataFrame) -> str:
        part = f"part-{uuid.uuid4().hex}"
        rows.repartitionByRange(*self.keys).sortWithinPartitions(*self.keys).write.parquet(f"{self.path}/{part}/rows")
        written = self.spark.read.parquet(f"{self.path}/{part}/rows")
        index = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.min(self.keys[0]).alias("low"), F.max(self.keys[0]).alias("high"))
        index.write.parquet(f"{self.path}/{part}/index")
        return part

    def append(self, rows: DataFrame, skip_present: bool = False) -> int:
        """Append ``rows``, all or none; how many.

        ``KeyViolation`` if a key occurs twice in ``rows``, holds a null or is in
        the table; with ``skip_present`` rows of keys that are there are left out.
        """
        with scratch_scope(self.spark):
            rows = cut(rows)  # read again by every attempt
            bad = key_violations(rows, self.keys).limit(1).collect()
            if bad:
                raise KeyViolation(f"{self.path}: key {bad[0].asDict()}")
            for attempt in range(ATTEMPTS):
                number, parts = self._manifest()
                there = self._may_hold(parts, rows)
                fresh = rows
                if there is not None and skip_present:
                    fresh = cut(new_rows(rows, there, self.keys))
                elif there is not None:
                    bad = already_present(rows, there, self.keys).select(*self.keys).limit(1).collect()
                    if bad:
                        raise KeyViolation(f"{self.path}: key {bad[0].asDict()} is already present")
                many = fresh.count()
                if not many:
                    return 0
                part = self._write(fresh)
                try:
                    manifests.commit(self.spark, self.path, number + 1, {"parts": [*parts, part]})
                    return many
                except manifests.ConcurrentUpdate:
                    if attempt == ATTEMPTS - 1:
                        raise
        return 0
