"""A training-corpus pipeline over ``documents``: five operators, each stage working on all that the one before kept.

Defined results: null and empty texts are clean to the toxicity stage and have too few words for
the quality stage, which drops them; rows that repeat a doc_id are judged each, and the near-duplicate stage
keeps one of those with equal or similar texts; texts may have any length; an empty table gives an
empty result; all stages but the last return the documents' own columns, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noteproof.llm import near_dedup, packing, quality, suffix_dedup, toxicity
from noteproof.llm.common import materialize, ship, table
from noteproof.llm.queries import VOCABULARY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents below the severity at which op9 rejects."""
    ship(spark)
    return toxicity.filter_documents(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that op5 keeps."""
    ship(spark)
    return quality.filter_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group: five words a shingle, a similarity of 0.8 or more, as near-duplicate stages take
    (op10's own contract says 0.85)."""
    ship(spark)
    return near_dedup.drop_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of repeated 200-byte strings; characters cut apart go too."""
    ship(spark)
    return suffix_dedup.deduplicated(docs, stored=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, as op7 returns them."""
    ship(spark)
    return packing.pack_documents(docs, VOCABULARY, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

#: Trained weights, hashed n-grams and packing patterns have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(spark, docs, f"stage-{name}")
    return docs
