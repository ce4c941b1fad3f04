"""Registered queries of the training-data operators: thin digests over the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, html_text, lattice_lm, near_dedup, oracles, packing, piece_bpe, prefix_trie, quality, resampling, suffix_dedup, token_files, toxicity
from .common import checkpoint_root, ship, table

Query = Callable[[SparkSession, str], DataFrame]


#: Looked up where it is read, on driver and workers.
VOCABULARY = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.decode_documents(bpe.encode_documents(table(spark, sf_dir, "documents"), VOCABULARY), VOCABULARY)
    return decoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), stored=True).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_root(spark)}/noteproof/tokens-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), VOCABULARY, folder, end_id=2)
    read = token_files.read_token_files(spark, folder)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY, end_id=1)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_documents(table(spark, sf_dir, "documents"), VOCABULARY)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score_documents(docs, toxicity.fit(docs, labels))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv_id = F.col("conv_id")
    head = F.crc32(conv_id.cast("string").cast("binary")) % 9
    return prefix_trie.trie_nodes(table(spark, sf_dir, "conversations"), head, conv_id - conv_id % 5)


def op12_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = piece_bpe.decode_documents(piece_bpe.encode_documents(table(spark, sf_dir, "documents"), PIECES), PIECES)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(
        "doc_id",
        "n_tokens",
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_ALL: list[Query] = [
    op1_bpe_round_trip, op2_html_extraction, op3_suffix_dedup, op4_embedding_near_dedup, op5_quality_rules, op6_token_files, op7_packing,
    op8_lm_scoring, op9_toxicity, op10_near_dedup, op11_prefix_trie, op12_piece_round_trip, op13_importance_resampling,
]


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {q.__name__: _shipped(q) for q in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op11_prefix_trie": oracles.PREFIX_TRIE, "op13_importance_resampling": oracles.RESAMPLING}
