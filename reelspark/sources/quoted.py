"""Reading CSV with line breaks inside quotes by many tasks.

A line break ends a record if the quotes before it in the file are even in
number (an escaped quote counts twice). The file is read in splits by lines:
first the quotes of every split are counted, and the sums over the splits before
it tell for each whether it starts inside quotes; then every split is cut into
records where its running count is even. What stands before a split's first
border and after its last are pieces of records that go on in other splits; only
those, two a split at most, are brought together and joined.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Splits of a table at most; their counts, a row each, are broadcast. Larger tables need larger splits.
MOST_SPLITS = 100_000
INSIDE, HEAD, TAIL, WHOLE = "inside", "head", "tail", "whole"
PIECES = "file string, start bigint, kind string, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): the lines of all files, in order within each split."""
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _cut(batches):
    """Lines with the quotes before their split to pieces: whole records, and what is left at either end of a split."""
    now, held, odd, first = None, [], 0, True

    def end():
        if now is not None and held:
            # Without any border the whole split is inside of a record.
            yield now, INSIDE if first else TAIL, "\n".join(held)

    for batch in batches:
        file, start, value = (batch.column(c) for c in ("file", "start", "value"))
        before = batch.column("before").to_numpy()
        quotes = pc.count_substring(value, '"').to_numpy(zero_copy_only=False)
        texts, files, starts = value.to_pylist(), file.to_pylist(), start.to_pylist()
        out: list[tuple] = []
        for i, text in enumerate(texts):
            if (files[i], starts[i]) != now:
                out += end()
                now, held, odd, first = (files[i], starts[i]), [], int(before[i]) % 2, True
                # A split that starts outside of quotes starts with a record, since lines are never cut.
                first = odd == 1
            held.append(text)
            odd = (odd + int(quotes[i])) % 2
            if not odd:
                out.append((now, HEAD if first else WHOLE, "\n".join(held)))
                held, first = [], False
        yield _batch(out)
    yield _batch(list(end()))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array([r[0][0] for r in rows], pa.string()), pa.array([r[0][1] for r in rows], pa.int64()),
         pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
        names=["file", "start", "kind", "record"])


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(record): the records of the CSV files at ``path``, headers included; blank ones are left out.

    Quotes are ``"``, escaped by doubling. A quote that is never closed makes the
    rest of its file one record.
    """
    lines = _lines(spark, path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    splits = lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes"))
    earlier = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("quotes").over(earlier), F.lit(0))).drop("quotes")
    if splits.count() > MOST_SPLITS:
        raise ValueError(f"over {MOST_SPLITS} splits: raise spark.sql.files.maxPartitionBytes")
    # A broadcast join keeps the lines of a split together and in order.
    known = lines.join(F.broadcast(splits), ["file", "start"], "left").withColumn(
        "before", F.coalesce("before", F.raise_error(F.lit("the splits of the files have changed")).cast("bigint")))
    pieces = known.select("file", "start", "value", "before").mapInArrow(_cut, PIECES)
    whole = pieces.filter(F.col("kind") == WHOLE).select("record")
    # A tail starts a record, what is inside goes on, a head ends it; two rows a split at most.
    order = F.struct("start", F.when(F.col("kind") == TAIL, 1).otherwise(0))
    parts = pieces.filter(F.col("kind") != WHOLE).withColumn("order", order)
    number = F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(W.partitionBy("file").orderBy("order"))
    joined = parts.withColumn("n", number).groupBy("file", "n").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("order", "record"))), lambda x: x["record"]), "\n").alias("record"))
    records = whole.unionByName(joined.select("record"))
    # A carriage return belongs to the line break it stands before, also inside of quotes.
    plain = F.regexp_replace(F.replace("record", F.lit("\r\n"), F.lit("\n")), "\r$", "")
    return records.select(plain.alias("record")).filter(F.col("record") != "")


def _same_headers(spark: SparkSession, path: str, header: list[str]) -> None:
    """Refuse files whose first line is not the first file's; headers have no line breaks."""
    top = W.partitionBy("file").orderBy("start", "n")
    lines = _lines(spark, path).withColumn("n", F.monotonically_increasing_id())
    found = lines.filter(F.col("start") == 0).withColumn("k", F.row_number().over(top)).filter("k = 1")
    names = F.from_csv(F.regexp_replace("value", "\r$", ""), ", ".join(f"`{i}` STRING" for i in range(len(header) + 1)), {"escape": '"'})
    got = found.select("file", F.filter(F.array(*[names[f"{i}"] for i in range(len(header) + 1)]), lambda x: x.isNotNull()).alias("names"))
    bad = got.filter(F.col("names") != F.array(*[F.lit(h) for h in header])).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].file}: header {bad[0].names}, not {header}")


def read_quoted_csv(spark: SparkSession, path: str, null_value: str | None = None) -> DataFrame:
    """The CSV files at ``path`` as strings by the names of their common header.

    Records equal to the header are left out, as every file starts with one; a
    file whose header differs is refused.
    """
    first = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"').schema
    header = [f.name for f in first]
    _same_headers(spark, path, header)
    options = {"escape": '"', "mode": "PERMISSIVE"} | ({"nullValue": null_value} if null_value is not None else {})
    schema = ", ".join(f"`{i}` STRING" for i in range(len(header)))
    rows = quoted_records(spark, path).select(F.from_csv("record", schema, options).alias("r"))
    is_header = F.lit(True)
    for i, name in enumerate(header):
        is_header = is_header & F.col(f"r.`{i}`").eqNullSafe(F.lit(name))
    return rows.filter(~is_header).select(*[F.col(f"r.`{i}`").alias(n) for i, n in enumerate(header)])
