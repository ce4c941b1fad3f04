"""Driver tables in the shapes of the domain: commits, changed files, claims, checks.

Orders stand for commits, their line items for changed files, nations for repositories, event
streams for series of past checks, documents' lines and benchmark items for texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sha, author, repo, committed_at, subject, status, worth."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("sha"),
        F.col("o_custkey").alias("author"),
        F.col("c_nationkey").alias("repo"),
        F.col("o_orderdate").alias("committed_at"),
        F.col("o_orderpriority").alias("subject"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("worth"),
    )


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sha, path, additions, deletions, status, ord and the line's other numbers."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("sha"),
        F.concat_ws("/", F.regexp_replace("p_type", " ", "/"), F.regexp_replace("p_name", " ", "_")).alias("path"),
        F.col("l_quantity").cast("long").alias("additions"),
        F.col("l_linenumber").cast("long").alias("deletions"),
        F.col("l_linestatus").alias("status"),
        F.col("l_linenumber").alias("ord"),
        F.col("l_returnflag").alias("verdict_code"),
        F.col("l_discount").alias("discount"),
        F.col("l_suppkey").alias("supplier"),
        F.col("l_partkey").alias("part"),
        F.col("l_tax").alias("tax"),
    )


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry, tag, published_at, score, label, unjudged: one row per past check."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").alias("entry"),
        F.col("event_id").alias("tag"),
        F.col("ts").alias("published_at"),
        F.least(F.lit(100), F.floor("value")).cast("long").alias("score"),
        F.col("event_type").alias("label"),
        (F.col("event_type") == "error").cast("int").alias("unjudged"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, line: documents cut at newlines."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
