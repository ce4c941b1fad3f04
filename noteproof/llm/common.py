"""Shared plumbing of the training-data operators: table access, executor paths,
checkpoint folder, partition counts."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

REPO_ROOT = str(Path(__file__).resolve().parents[2])

#: ASCII white space of every word contract: space and the controls 0x09-0x0D.
WS_CLASS = "[ \\t-\\r]+"


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package when it is used from a source tree, and bound their batches by rows and bytes."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO_ROOT, *paths])
    # batches of whole texts stay small beside an executor's Python memory
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset, a temporary one in local mode (tests) and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.conf.get("spark.noteproof.tempCheckpointDir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="noteproof-")
            spark.conf.set("spark.noteproof.tempCheckpointDir", root)
    return root.rstrip("/")


def materialize(spark: SparkSession, df: DataFrame, what: str, **options: str) -> DataFrame:
    """Cut lineage: write ``df`` once as a table in the shared folder and read it back.

    The written table survives lost executors, and everything downstream re-reads it
    instead of recomputing Python stages.
    """
    path = f"{checkpoint_root(spark)}/noteproof/{what}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counted(spark: SparkSession, df: DataFrame, what: str) -> tuple[DataFrame, int]:
    """:func:`materialize`, and how many rows were written: counted by the write itself, with no job of its own."""
    seen = Observation()
    held = materialize(spark, df.observe(seen, F.count(F.lit(1)).alias("n")), what)
    return held, seen.get["n"]


def range_numbered(spark: SparkSession, df: DataFrame, order: list[Column], what: str, keep: list[str] | None = None) -> DataFrame:
    """``df`` (of it the columns ``keep``) dealt into sorted ranges and stored, with ``part`` (range, in order) and ``place`` (row within it, from 0).

    Rows of one key may lie in several ranges; a row's number among all is its place and the sizes of earlier ranges."""
    keep = keep or df.columns
    sorted_ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = materialize(spark, sorted_ranges.select(*keep, F.monotonically_increasing_id().alias("_at")), what)
    low = F.lit((1 << 33) - 1).cast("long")
    return held.select(*keep, F.shiftright("_at", 33).cast("int").alias("part"), F.col("_at").bitwiseAND(low).alias("place"))


def row_numbers(scan: DataFrame, name: str) -> DataFrame:
    """The scan of a stored table with a unique number of each row, made of its file's place among all files and its row within it.

    The number is the same whenever and however the table is read; how a reader splits the files has no part in it.
    Files are numbered by path: one broadcast row per file."""
    at = scan.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = at.select("_file").distinct().withColumn("_place", F.row_number().over(Window.orderBy("_file")).cast("long"))
    number = F.shiftleft("_place", 40).bitwiseOR(F.col("_row")).alias(name)
    return at.join(F.broadcast(files), "_file").select(*[F.col(f"`{c}`") for c in scan.columns], number)


def drop_materialized(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables written by :func:`materialize` once nothing reads them any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for df in frames:
        for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/noteproof/" in root:
                path = jvm.org.apache.hadoop.fs.Path(root)
                path.getFileSystem(conf).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


#: Keys with more than one in so many of all rows are joined by broadcast: there are fewer than this.
HEAVY = 1_000


def left_join_heavy(rows: DataFrame, table: DataFrame, on: list[str], share: str, total: int) -> DataFrame:
    """``rows`` left joined with ``table`` (one row per key, ``share`` of ``total`` rows each).

    Keys that hold a large part of all rows are joined by broadcast, whose size ``HEAVY`` bounds, so that none meets in one task."""
    heavy = F.broadcast(table.where(F.col(share) * HEAVY > total))
    return rows.join(heavy, on).unionByName(rows.join(heavy, on, "left_anti").join(table, on, "left"))
