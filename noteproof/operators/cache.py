"""A cache of answers by fingerprint: what is known is read, what is missing is computed once and kept, old versions are collected.

The cache is a folder of tables, ``version=.../run=.../``; a run that is repeated, as a streaming batch after a failure, overwrites its own folder and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_name
from ..stored import stored

SCHEMA = "key string, value string, version string, run string"


def fingerprint(*columns: str) -> Column:
    """SHA-256 of named inputs in the order of their names; a null is told apart from a text."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)


def _folder(spark: SparkSession, path: str):
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), held


def read(spark: SparkSession, path: str) -> DataFrame:
    """key, value, version, run of all that is kept; nothing where the folder is not there yet."""
    files, held = _folder(spark, path)
    if not files.exists(held) or not files.listStatus(held):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def keep(answers: DataFrame, path: str, version: str, run: str) -> None:
    """Keep answers (key, value) of one run, in place of what the same run kept before."""
    answers.select("key", "value").write.mode("overwrite").parquet(f"{path}/version={safe_name(version)}/run={safe_name(run)}")


def answered(asked: DataFrame, path: str, version: str, run: str, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``asked`` (key, ...) with value and cached, and the misses that were computed (key, ...).

    compute: from distinct misses (columns of ``asked``) to key, value. Misses are found by one anti join; equal keys are computed once."""
    spark = asked.sparkSession
    known = read(spark, path).where(F.col("version") == safe_name(version)).groupBy("key").agg(F.max_by("value", "run").alias("value"))
    misses = stored(asked.join(known, "key", "left_anti").dropDuplicates(["key"]), "misses")
    hits = stored(asked.join(known, "key").withColumn("cached", F.lit(True)), "hits")
    keep(compute(misses), path, version, run)
    fresh = read(spark, path).where((F.col("version") == safe_name(version)) & (F.col("run") == safe_name(run))).select("key", "value")
    return hits.unionByName(asked.join(fresh, "key").withColumn("cached", F.lit(False))), misses


def stream_into(answers: DataFrame, path: str, version: str, checkpoint: str) -> None:
    """Keep a stream of answers (key, value), each batch under its number, so that a batch run twice changes nothing."""
    query = answers.writeStream.foreachBatch(lambda df, batch: keep(df, path, version, f"batch-{batch}")).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def histogram(cache: DataFrame) -> DataFrame:
    """version, answers (distinct keys), rows, characters of what is kept."""
    return cache.groupBy("version").agg(F.countDistinct("key").alias("answers"), F.count(F.lit(1)).alias("rows"), F.sum(F.length("value")).alias("characters"))


def collect_versions(spark: SparkSession, path: str, version: str) -> list[str]:
    """Drop what other versions kept; the versions that went."""
    files, held = _folder(spark, path)
    gone = sorted(s.getPath().getName() for s in files.listStatus(held) if s.getPath().getName() != f"version={safe_name(version)}") if files.exists(held) else []
    for name in gone:
        files.delete(held.suffix(f"/{name}"), True)
    return [name.removeprefix("version=") for name in gone]
