"""The watch loop as a stream: a per-entry cursor, counts and labels that late rows never lower.

The cursor is the furthest published check of an entry, a high-water mark and not a watermark: late
rows are counted and never dropped. Checks are folded through an associative merge, so the batch
result over the same rows is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ledgers

LEDGER = "entry long, cursor_tag long, checked long, top_label string"


def _folded(checks: DataFrame) -> DataFrame:
    return checks.groupBy("entry").agg(
        F.max(F.struct("published_at", "tag")).alias("cursor"), F.count(F.lit(1)).alias("checked"), F.max("label").alias("top_label")
    )


def ledger_of(checks: DataFrame) -> DataFrame:
    """entry, cursor_tag, checked, top_label of checks (entry, tag, published_at, label), batch or stream."""
    return _folded(checks).select("entry", F.col("cursor.tag").alias("cursor_tag"), "checked", "top_label")


def run_ledger(spark: SparkSession, source: str, schema: str, name: str, checkpoint: str, *, files_per_trigger: int = 1) -> DataFrame:
    """Replay a folder of parquet files of checks as a stream until it is used up; the ledger as a table.

    State is the aggregate's own; the checkpoint makes it survive restarts and allows one writer."""
    checks = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    q = (
        ledger_of(checks).writeStream.outputMode("complete").format("memory").queryName(name)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.table(name)


def alerts(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, *, below: int = 45, kept: int = ledgers.ALERTS_KEPT) -> None:
    """Checks scored under ``below``, each (entry, tag) written once however often and however late it is delivered (``ledgers.SentAlerts``)."""
    checks = spark.readStream.schema(schema).parquet(source)
    ledgers.replay(ledgers.alerts(checks, below=below, kept=kept), out, checkpoint)
