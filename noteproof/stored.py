"""Tables written once in the folder that all executors share, so that what several branches read is computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a temporary one in local mode and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.conf.get("spark.noteproof.tempCheckpointDir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="noteproof-")
            spark.conf.set("spark.noteproof.tempCheckpointDir", root)
    return root.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as a table and read back: it survives lost executors and ends the plan that made it."""
    spark = df.sparkSession
    path = f"{folder(spark)}/noteproof/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
