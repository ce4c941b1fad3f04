"""Token-id files: canonical length-limited Huffman codes in independent blocks.

The code comes from global id counts. Its file format is a table of blocks, sorted by document
id, and a code book:

* ``codebook``: ids in canonical order with their code lengths (at most 16 bits), and each
  file's place: ``file``, ``first_id`` (ids in all files before it), ``n_ids``.
* ``blocks``: ``file``, ``block``; ``doc_ids`` and ``doc_tokens`` of whole documents in ascending
  order; ``starts`` (ids before each document in this file); ``payload``, the bit stream;
  ``checkpoints``, the bit offset of every 256th id. A block needs nothing but the code book.

Decoding reads all checkpoint lanes of a block side by side through one 2^16-entry table.

Tables are written by Spark's own writer into a folder that the caller names, so lost executors
cost only their tasks and any store that Spark writes to will do.

Defined results: null text is empty and holds the end id alone; repeated rows are each written;
null doc_ids sort first; texts may have any length; columns other than doc_id and text are not
read, whatever their names; empty input writes no blocks and reads back empty.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import drop_materialized, materialize, shuffle_partitions, text_or_empty

MAX_BITS = 16
LANE = 256
BLOCK_IDS = 1 << 16
#: Blocks that are decoded side by side.
AT_ONCE = 8


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` by package-merge; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) == 1:
        lengths[used] = 1
    if len(used) < 2:
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError("more ids than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    levels, weights = [], leaf
    is_leaf = np.ones(len(leaf), bool)
    for _ in range(max_bits):
        levels.append(is_leaf)
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([leaf, pairs])
        by = np.argsort(merged, kind="stable")
        weights, is_leaf = merged[by], by < len(leaf)
    take, depth = 2 * len(leaf) - 2, np.zeros(len(leaf), np.int64)
    for flags in reversed(levels):
        n = int(flags[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code of each id: counted upwards by (length, id)."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    code = last = 0
    for k in order.tolist():
        code <<= int(lengths[k]) - last
        last = int(lengths[k])
        codes[k] = code
        code += 1
    return codes


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream of ids, most significant bit first, and the bit offset of each id."""
    n = lengths[ids]
    ends = np.cumsum(n)
    starts = ends - n
    if not len(ids):
        return b"", starts
    # a code touches at most two 32-bit words
    word, room = starts >> 5, 64 - (starts & 31) - n
    wide = codes[ids].astype(np.uint64) << room.astype(np.uint64)
    out = np.zeros(int(ends[-1] + 31 >> 5) + 2, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] |= np.bitwise_or.reduceat(wide >> np.uint64(32), first)
    out[word[first] + 1] |= np.bitwise_or.reduceat(wide & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes()[: int(ends[-1] + 7 >> 3)], starts


class Decoder:
    """Table-driven: the next 16 bits name the id and how far to go on."""

    def __init__(self, lengths: np.ndarray):
        codes = canonical_codes(lengths)
        self.id, self.step = np.zeros(1 << MAX_BITS, np.uint32), np.ones(1 << MAX_BITS, np.uint8)
        used = np.flatnonzero(lengths)
        for k in used[np.lexsort((used, lengths[used]))].tolist():
            free = MAX_BITS - int(lengths[k])
            low = int(codes[k]) << free
            self.id[low : low + (1 << free)] = k
            self.step[low : low + (1 << free)] = lengths[k]

    def __call__(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        return self.blocks([payload], [checkpoints], [n])[0]

    def blocks(self, payloads: list[bytes], checkpoints: list[np.ndarray], counts: list[int]) -> list[np.ndarray]:
        """Ids of each block; the lanes of all of them go on side by side."""
        # a last lane may run out before the others: it then reads on for less than the zeros here
        pad = b"\0" * (LANE * MAX_BITS // 8 + 4)
        sizes = np.array([len(p) + len(pad) for p in payloads], np.int64)
        data = np.frombuffer(pad.join([*payloads, b""]), np.uint8).astype(np.uint32)
        window = np.zeros(len(data), np.uint32)
        window[:-2] = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        lanes = np.array([len(c) for c in checkpoints], np.int64)
        at = np.concatenate([c.astype(np.int64) for c in checkpoints]) + np.repeat(8 * (np.cumsum(sizes) - sizes), lanes)
        out = np.zeros((LANE, len(at)), np.uint32)
        for k in range(min(LANE, max(counts, default=0))):
            bits = window[at >> 3] >> (8 - (at & 7)).astype(np.uint32) & 0xFFFF
            out[k] = self.id[bits]
            at += self.step[bits]
        found, ends = out.T.reshape(-1), np.cumsum(lanes)
        return [found[LANE * (e - m) : LANE * (e - m) + n] for e, m, n in zip(ends.tolist(), lanes.tolist(), counts, strict=True)]


def id_type(path: str, end_id: int) -> str:
    """Two bytes an id where the vocabulary allows, else four."""
    with open(tokens.vocabulary_file(path), encoding="utf-8") as f:
        spec = json.load(f)
    largest = max([end_id, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    return "<u2" if largest < 1 << 16 else "<u4"


def encoded_documents(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, ids: ids of the whole text and the end id, as little-endian unsigned integers of ``id_type``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, kind = tokens.library(path), id_type(path, end_id)
        for batch in tokens.gathered(batches):
            ids, ends = tokens.with_end(*enc.encode_column(batch.column(1)), end_id)
            yield pa.RecordBatch.from_arrays([batch.column(0), tokens.as_binary(ids.astype(kind), ends)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, ids binary")


def count_ids(encoded: DataFrame, end_id: int, kind: str) -> np.ndarray:
    """Occurrences of each id over all documents; one row per id and task goes to the driver's sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            got = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind))
            if len(got) > len(total):
                total = np.pad(total, (0, len(got) - len(total)))
            total[: len(got)] += got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    rows = encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([end_id, *(r.id for r in rows)]) + 1, np.int64)  # one row per vocabulary entry
    for r in rows:
        counts[r.id] = r.n
    return counts


_BLOCKS = "file long, block long, doc_ids array<long>, doc_tokens array<long>, starts array<long>, payload binary, checkpoints array<long>"


def write_token_files(docs: DataFrame, path: str, folder: str, *, end_id: int, max_bits: int = MAX_BITS) -> None:
    """Write all documents, each followed by ``end_id``, in ascending doc_id order."""
    spark = docs.sparkSession
    kind = id_type(path, end_id)
    wide = int(kind[-1])
    # encoded once: counted, then dealt out in order
    encoded = materialize(spark, encoded_documents(docs, path, end_id), "ids", compression="zstd")
    lengths = code_lengths(count_ids(encoded, end_id, kind), max_bits)
    codes = canonical_codes(lengths)
    ordered = encoded.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, block, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, bytes]] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, start
            sizes = np.array([len(x) // wide for _, x in held], np.int64)
            ids = np.frombuffer(b"".join(x for _, x in held), kind)
            payload, at = pack_bits(ids, codes, lengths)
            starts = start + np.cumsum(sizes) - sizes
            columns = [[file], [block], [[d for d, _ in held]], [sizes], [starts], [payload], [at[::LANE]]]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
            block, start = block + 1, start + len(ids)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _BLOCKS.split(", ")])

        for batch in batches:
            size = sum(len(x) for _, x in held) // wide
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((doc, ids))
                size += len(ids) // wide
                if size >= BLOCK_IDS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    ordered.mapInArrow(run, _BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")
    drop_materialized(spark, encoded)
    blocks = spark.read.parquet(f"{folder}/blocks")
    per_file = blocks.select("file", F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("file").agg(F.sum("n").alias("n_ids"))
    sizes = sorted((r.file, r.n_ids) for r in per_file.collect())  # one row per file
    places, first = [], 0
    for file, n in sizes:
        places.append((file, first, n))
        first += n
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    book = spark.createDataFrame(
        [(order.tolist(), lengths[order].tolist(), places)],
        "ids array<int>, lengths array<int>, files array<struct<file: long, first_id: long, n_ids: long>>",
    )
    book.coalesce(1).write.parquet(f"{folder}/codebook")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids: decoded block by block."""
    book = spark.read.parquet(f"{folder}/codebook").first()
    lengths = np.zeros(max([0, *book.ids]) + 1, np.int64)
    lengths[np.array(book.ids, np.int64)] = book.lengths
    first = {f.file: f.first_id for f in book.files}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(lengths)
        for batch in batches:
            for low in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(low, AT_ONCE)
                lanes = [some.column(6).slice(k, 1).flatten().to_numpy() for k in range(some.num_rows)]
                all_sizes = [some.column(3).slice(k, 1).flatten().to_numpy() for k in range(some.num_rows)]
                decoded = decode.blocks(some.column(5).to_pylist(), lanes, [int(x.sum()) for x in all_sizes])
                for k, (file, sizes) in enumerate(zip(some.column(0).to_pylist(), all_sizes, strict=True)):
                    docs, starts = (some.column(c).slice(k, 1).flatten() for c in (2, 4))
                    yield pa.RecordBatch.from_arrays(
                        [docs, pa.array(starts.to_numpy() + first[file]), pa.array(sizes), tokens.as_binary(decoded[k].astype("<u4", copy=False), np.cumsum(sizes))],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks").select(*[c.split()[0] for c in _BLOCKS.split(", ")])
    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")

