"""A training corpus from raw documents: quality, near copies, repeated passages, leaks, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; ``run`` applies them to the table ``documents``. Stages but the last
return the columns of the documents they get.

Rows with a null ``doc_id`` pass the stages that compare documents: they can be
neither a copy's original nor be found again by their id. Null texts are empty
ones to every stage. Extra columns are kept until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm import decontaminate, quality, queries, simhash, substring
from reelspark.llm.common import cut, fresh, table

#: Documents that score below this are rejected.
LEAST_QUALITY = 0.7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = queries.quality_model(spark, table(spark, sf_dir, "documents"), sf_dir)
    return quality.keep(docs, model, LEAST_QUALITY)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints, the document with the smallest id, once.

    Where an id stands on several rows, they are told apart by their texts.
    """
    known = docs.filter("doc_id is not null")
    repeated = cut(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"))
    if repeated.isEmpty():
        found = simhash.simhash_components(known, shingle=4, bits=4)
        copies = cut(found.filter("component_id <> doc_id").select("doc_id").distinct())
        return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
    digest, both, row = fresh(docs, "digest"), fresh(docs, "both"), fresh(docs, "row")
    told = docs.withColumn(digest, F.xxhash64("text"))
    known = told.filter("doc_id is not null").select(F.struct("doc_id", digest).alias(both), "text")
    found = simhash.simhash_components(known, key=both, shingle=4, bits=4)
    copies = cut(found.filter(F.col("component_id") != F.col(both)).select(f"{both}.*").distinct())
    kept = told.join(copies, ["doc_id", digest], "left_anti")
    # Rows without an id are told apart, so that none of them is dropped as a repeat.
    number = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    return kept.withColumn(row, number).dropDuplicates(["doc_id", digest, row]).select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that a smaller document also has."""
    return substring.replace_text(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark text."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 1024 tokens."""
    return queries.packed(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
