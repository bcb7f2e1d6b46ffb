"""Numbered manifests: files that appear at once and complete under their number, or not at all."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class ConcurrentUpdate(RuntimeError):
    """Another writer has changed the table since its manifest was read."""


def files(spark: SparkSession, path: str):
    """(file system of the path, JVM)."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def latest(spark: SparkSession, path: str) -> tuple[int, dict] | None:
    """(number, fields) of the newest manifest of the table at ``path``, None if there is none."""
    fs, jvm = files(spark, path)
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    if not fs.exists(folder):
        return None
    numbers = [int(n) for n in (s.getPath().getName() for s in fs.listStatus(folder)) if n.isdigit()]
    if not numbers:
        return None
    return max(numbers), json.loads(spark.read.text(f"{path}/manifests/{max(numbers)}", wholetext=True).first()[0])


def commit(spark: SparkSession, path: str, number: int, fields: dict) -> None:
    """Let a manifest appear under its number; ``ConcurrentUpdate`` if another writer took it."""
    fs, jvm = files(spark, path)
    hadoop = jvm.org.apache.hadoop.fs
    fs.mkdirs(hadoop.Path(f"{path}/manifests"))
    draft, final = hadoop.Path(f"{path}/manifests/draft-{uuid.uuid4().hex}"), hadoop.Path(f"{path}/manifests/{number}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(fields).encode()))
    out.close()
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(context.makeQualified(draft), context.makeQualified(final), no_options)  # refuses a name that is taken
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise ConcurrentUpdate(f"{path}: manifest {number} is there") from e
        raise
