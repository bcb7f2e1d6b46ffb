"""What several of the operators need: tables, lineage cuts, bounded samples."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions import lineage

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the length of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it from there.

    Spark drops the shuffle files of the write as soon as it has ended, so the
    disk a chain of cuts needs is that of its largest link.
    """
    with setting(df.sparkSession, CLEANUP, "true"):
        return lineage.cut(df)


def share(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    steps = 1 << 30
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(steps)) / F.lit(float(steps))


def bounded_sample(rows: DataFrame, key: str, bound: int, seed: int = 0) -> DataFrame:
    """About ``bound`` rows, or all if there are fewer, chosen by a hash of the key.

    The number of rows is counted first; the choice is the same on every run.
    """
    total = rows.count()
    if total <= bound:
        return rows
    return rows.filter(share(F.col(key), seed) < F.lit(bound / total))


#: Bits of the table that ``having`` sends to all tasks, 32 a number.
BITS = 1 << 21


def having(rows: DataFrame, ids: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """The rows whose key is one of ``ids``, however many these are.

    A table of bits by hash of the id, of fixed size, is a constant of the plan;
    rows whose bit is set are shuffled and joined with the ids. The join is the
    same for few ids and for many. Null keys match none, ids may repeat.
    """
    at = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(bits)).cast("int")
    word, bit = F.floor(at / F.lit(32)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(at, F.lit(32)))
    found = ids.select(key).filter(F.col(key).isNotNull()).distinct()
    none = rows.sparkSession.range(bits // 32).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("bigint").alias("bit"))
    words = found.select(word.alias("word"), bit.alias("bit")).union(none).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    text = words.agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"].cast("string")), ",")).first()[0]
    table = F.split(F.lit(text), ",").cast("array<bigint>")
    may = F.get(table, word).bitwiseAND(bit) != 0
    return rows.filter(F.col(key).isNotNull()).filter(may).join(found.hint("shuffle_hash"), key, "left_semi")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, node) that connect what the edges (a, b) connect, one per node."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        after = label.copy()
        np.minimum.at(after, left, low)
        np.minimum.at(after, right, low)
        after = after[after]
        if np.array_equal(after, label):
            break
        label = after
    other = label != np.arange(len(nodes))
    return nodes[label[other]], nodes[other]


#: Bytes of text that a task handles at a time.
SLICE_BYTES = 2 << 20


def slices(batches, column: str, most: int = SLICE_BYTES):
    """The batches cut into pieces whose texts hold at most ``most`` bytes, or one row."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        row = 0
        while row < len(ends):
            done = ends[row - 1] if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(row, stop - row)
            row = stop


def is_held_out(key: Column, parts: int, held: int) -> Column:
    """Whether the crc32 of the key as text, modulo ``parts``, is ``held``; true for a null key, so it is never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == held, F.lit(True))


#: Characters that a line counts for beside its own, when texts are chosen by size.
LINE_CHARS = 64


def labelled_texts(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int, key: str = "doc_id", text: str = "text"
) -> tuple[list[str], np.ndarray]:
    """Whole texts and 0/1 labels to fit a classifier on: about ``rows`` labelled rows and ``chars`` characters at most.

    Rows are chosen by hashes of the key alone: first about ``rows`` of the
    labels, which are broadcast, then of these, in the order of another hash, as
    many as together hold ``chars`` characters, a line counting for
    ``LINE_CHARS`` more; the first is taken whatever it holds.
    """
    known = labels.filter(F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).alias("label"))
    chosen = F.broadcast(bounded_sample(known, "key", rows))
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    found = cut(texts.join(chosen, "key").withColumn("place", share(F.col("key"), 1)))
    size = F.length("text") + F.lit(LINE_CHARS) * (F.length("text") - F.length(F.translate("text", "\n", "")) + 1)
    # A row for each chosen key.
    sizes = found.groupBy("place").agg(F.sum(size).alias("size")).orderBy("place").collect()
    ends = np.cumsum([r["size"] for r in sizes])
    if len(sizes) and ends[-1] > chars:
        last = sizes[max(0, int(np.searchsorted(ends, chars, side="right")) - 1)]["place"]
        found = found.filter(F.col("place") <= F.lit(last))
    got = found.orderBy("key", "text").select("text", "label").toArrow()
    return got["text"].to_pylist(), got["label"].to_numpy().astype(np.int64)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
