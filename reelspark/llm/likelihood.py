"""Quality rules by a hashed n-gram log-likelihood ratio, in DataFrame functions alone.

Two multinomials over hashed n-grams are counted: one over trusted texts, one
over the raw corpus. The n-grams are words, pairs of words and the last three
characters of words, which say something of words that were never seen. A document's score is the mean over
its n-grams of the log of the ratio of their probabilities, so its length
doesn't matter. It is kept if no plain rule fails it and the score reaches a
fixed threshold.

Shuffled are only ``BUCKETS`` counts by task. The ratios are a constant array of
fixed size in the plan; a document is scored in its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import cut

BUCKETS = 1 << 16
#: Characters of a word's end.
ENDS = 3
#: Added to every bucket's count in both multinomials.
SMOOTHING = 1.0
#: Mean log ratio that a document must reach.
LEAST = -0.5
#: The plain rules: words a document has at least, and per cent of them in repeated windows at most.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Repeated windows up to this many are looked up in a list, more by sorting all windows with their places.
FEW = 32
#: The white space between words, and the symbols that are counted.
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


def words(text: Column) -> Column:
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(flat, " "), "")


def with_repeated_words(rows: DataFrame, hashes: str, name: str, n: int = 3) -> DataFrame:
    """Add the number of words in windows of ``n`` that a text has twice or more.

    ``hashes`` are the 64-bit hashes of its words; windows are told apart by
    hashes of those. Each step is a column of its own, since an expression
    inside a lambda would be computed for every element.
    """
    def places_of(starts: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(*[i + k for k in range(n)])))))

    many = F.size(hashes)
    windows = F.slice(hashes, 1, F.greatest(many - (n - 1), F.lit(0)))
    hashed = F.transform(windows, lambda x, i: F.xxhash64(x, *[F.get(F.col(hashes), i + k) for k in range(1, n)]))
    none = F.array().cast("array<bigint>")
    ordered = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array("_h")).otherwise(none)
    twice = F.array_distinct(F.filter("_o", lambda x, k: x == F.get(F.col("_o"), k - 1)))
    listed = F.filter(F.transform("_h", lambda x, i: F.when(F.array_contains("_d", x), i)), lambda i: i.isNotNull())
    placed = F.when(F.size("_d") > FEW, F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    beside = F.filter("_p", lambda s, k: (s["x"] == F.get(F.col("_p"), k - 1)["x"]).eqNullSafe(True)
                      | (s["x"] == F.get(F.col("_p"), k + 1)["x"]).eqNullSafe(True))
    found = (F.when(F.size("_d") == 0, F.lit(0)).when(F.size("_d") <= FEW, places_of(listed))
             .otherwise(places_of(F.transform(beside, lambda s: s["i"]))))
    return (
        rows.withColumn("_h", hashed).withColumn("_o", ordered).withColumn("_d", twice).withColumn("_p", placed)
        .withColumn(name, found.cast("bigint")).drop("_h", "_o", "_d", "_p")
    )


def _bucket(buckets: int, h: Column) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def _end(word: Column) -> Column:
    return F.xxhash64(F.lit("end"), F.right(word, F.lit(ENDS)))


def grams(w: Column, hashes: Column, buckets: int) -> Column:
    """Buckets of the words, their ends and the pairs of neighbours, from the words and their hashes, two columns."""
    rest = F.slice(hashes, 2, F.size(hashes))
    return F.concat(
        F.transform(hashes, lambda x: _bucket(buckets, x)),
        F.transform(w, lambda x: _bucket(buckets, _end(x))),
        F.transform(rest, lambda x, i: _bucket(buckets, F.xxhash64(F.get(hashes, i), x))))


def counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): the n-grams of all documents; every task sends a row per bucket at most.

    Words are unnested together with the word before, so that hashing and
    counting run in generated code.
    """
    w = F.col("w")
    before = F.concat(F.array(F.lit("")), w)
    pairs = docs.select(words(F.col(text)).alias("w")).select(
        F.inline(F.arrays_zip(w.alias("x"), before.alias("y"))).alias("x", "y")).filter("x is not null")
    pair = F.when(F.col("y") != "", _bucket(buckets, F.xxhash64(F.xxhash64("y"), F.xxhash64("x"))))
    rows = pairs.select(F.explode(F.array(
        _bucket(buckets, F.xxhash64("x")), _bucket(buckets, _end(F.col("x"))), pair)).alias("bucket"))
    return rows.filter("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def fit(raw: DataFrame, trusted: DataFrame, text: str = "text", buckets: int = BUCKETS) -> Column:
    """Per bucket the log of its probability in ``trusted`` over that in ``raw``, as a constant array.

    Counts cover all texts of both; the result is one row of as many numbers as
    there are buckets. Buckets that neither has, and tables without words, count
    by the smoothing alone.
    """
    zero = F.lit(0).cast("bigint")
    a = counts(raw, text, buckets).select("bucket", F.col("n").alias("r"), zero.alias("t"))
    b = counts(trusted, text, buckets).select("bucket", zero.alias("r"), F.col("n").alias("t"))
    none = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), zero.alias("r"), zero.alias("t"))
    every = a.union(b).union(none).groupBy("bucket").agg(F.sum("r").alias("r"), F.sum("t").alias("t"))
    one = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "r", "t"))).alias("all"),
                    F.sum("r").alias("R"), F.sum("t").alias("T"))
    add, space = F.lit(SMOOTHING), F.lit(SMOOTHING * buckets)
    ratio = F.transform("all", lambda x: F.log((x["t"] + add) / (F.col("T") + space))
                        - F.log((x["r"] + add) / (F.col("R") + space)))
    # As text, since that is one constant for the planner; numbers in text keep all their digits.
    text_of = one.select(F.array_join(F.transform(ratio, lambda x: x.cast("string")), ",")).first()[0]
    return F.split(F.lit(text_of), ",").cast("array<double>")


def quality_rules(
    docs: DataFrame, ratio: Column, key: str = "doc_id", text: str = "text", least: float = LEAST, buckets: int = BUCKETS,
) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) of every row.

    ``ratio`` is what ``fit`` gives for as many buckets. No shuffle: a text is
    read once, whole, in its own row. A null text counts as an empty one; a
    document without words scores 0 and fails the plain rules. Repeated rows and
    rows with a null key give a row each, other columns are not read, and an
    empty table gives no rows. A score is summed in the order of the words, so
    it is the same on every run; a document exactly at the threshold is kept.

    The result, some sixty bytes a row, is written to the shared folder: a later
    filter on a column would otherwise be pushed below the steps that compute it
    and repeat them for every word.
    """
    t, w, h = F.coalesce(F.col("text"), F.lit("")), F.col("w"), F.col("h")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).select(
        "key", words(t).alias("w"),
        F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACES}]"))).alias("lines"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"))
    rows = rows.select("key", "w", "lines", "n_symbols", F.transform(w, lambda x: F.xxhash64(x)).alias("h"))
    rows = with_repeated_words(rows, "h", "n_repeat_words").select(
        "key", F.size("w").cast("bigint").alias("n_words"), F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words", grams(w, h, buckets).alias("g"))
    total = F.aggregate("g", F.lit(0.0), lambda acc, b: acc + F.get(ratio, b))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    done = rows.withColumn(
        "score", F.when(F.size("g") > 0, total / F.size("g")).otherwise(F.lit(0.0))).withColumn("base_failed", failed)
    return cut(done.select(
        F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "score", (~F.col("base_failed") & (F.col("score") >= F.lit(least))).alias("kept")))
