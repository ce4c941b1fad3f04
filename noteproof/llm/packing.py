"""Packing documents into fixed-length sequences: cutting stock by column generation.

A document is cut into full sequences and one remainder. Remainders are binned into length
classes of ``GRAIN`` tokens (rounded up, so a pattern always fits), and their histogram - at most
``capacity / GRAIN`` numbers, whatever the corpus - is the demand of a cutting-stock linear
program. Its columns are patterns (how many of each class share a sequence); a knapsack dynamic
program prices them by the dual values until none improves. Patterns are used the whole number of
times below their solution, and what is left over is packed first-fit by decreasing length.

Documents are ranked inside their class without gathering a class in one task: ranks inside
buckets of bounded size, dealt by row number, shifted by the counts of the buckets before. A rank
names its pattern, sequence and slot.

Defined results: null and empty text hold the end id alone; repeated rows are packed each; null
doc_ids keep their rows; texts may have any length; columns other than doc_id and text are not read,
whatever their names; an empty table gives an empty result. Padding left is the rounding of
classes and the unfilled ends of patterns; full sequences have none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import materialize, text_or_empty

CAPACITY = 2048
GRAIN = 8
#: Rows of one (class, bucket) group, on average at most.
BUCKET_ROWS = 1_000
#: Pricing rounds; the patterns found so far are feasible whenever it stops.
MAX_ROUNDS = 5_000


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value and item counts, each item as often as it fits."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for w in range(1, capacity + 1):
        fits = int(np.searchsorted(sizes, w, "right"))
        best[w] = best[w - 1]
        if fits:
            got = best[w - sizes[:fits]] + values[:fits]
            k = int(got.argmax())
            if got[k] > best[w]:
                best[w], choice[w] = got[k], k
    counts, w = np.zeros(len(sizes), np.int64), capacity
    while w > 0:
        if choice[w] < 0:
            w -= 1
        else:
            counts[choice[w]] += 1
            w -= int(sizes[choice[w]])
    return float(best[capacity]), counts


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, max_rounds: int = MAX_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the optimal basis (classes x patterns) and how often each is used, a fraction."""
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(np.float64)
    inverse = np.diag(1.0 / np.diag(columns)) if m else np.zeros((0, 0))
    used = inverse @ demand
    for _ in range(max_rounds if m else 0):
        dual = inverse.sum(0)
        value, counts = knapsack(dual, sizes, capacity)
        if value <= 1 + 1e-9:
            break
        step = inverse @ counts
        ratio = np.where(step > 1e-11, used / np.where(step > 1e-11, step, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out] = counts
        amount, pivot = ratio[out], inverse[out] / step[out]
        used = np.maximum(used - amount * step, 0)
        used[out] = amount
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
    return columns.astype(np.int64), used


def whole_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and whole uses that meet the demand exactly."""
    columns, used = solve_patterns(sizes, demand.astype(np.float64), capacity)
    left, out = demand.copy(), []
    for k in np.argsort(-used, kind="stable").tolist():
        times = int(used[k] + 1e-7)
        held = columns[:, k] > 0
        if held.any():
            times = min(times, int((left[held] // columns[held, k]).min()))
        if times > 0 and held.any():
            out.append((columns[:, k].copy(), times))
            left -= columns[:, k] * times
    bins: list[list] = []
    for c in np.argsort(-sizes, kind="stable").tolist():
        for _ in range(int(left[c])):
            place = next((b for b in bins if b[0] >= sizes[c]), None)
            if place is None:
                bins.append(place := [capacity, np.zeros(len(sizes), np.int64)])
            place[0] -= int(sizes[c])
            place[1][c] += 1
    return out + [(b[1], 1) for b in bins]


def cut_documents(docs: DataFrame, path: str, *, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: full pieces, then the remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.library(path)
        for batch in batches:
            ids, ends = tokens.with_end(*enc.encode_column(batch.column(1)), end_id)
            data = memoryview(ids.tobytes())
            totals = np.diff(ends, prepend=0)
            pieces = -(-totals // capacity)
            doc = np.repeat(np.arange(len(ends)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            length = np.minimum(capacity, totals[doc] - start)
            low = 4 * ((ends - totals)[doc] + start)
            sums = [zlib.crc32(data[a:b]) for a, b in zip(low.tolist(), (low + 4 * length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), *[pa.array(x, pa.int64()) for x in (start, length, sums, totals[doc])]],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return picked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def rank_in_class(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Adds ``rank`` from 0 within ``cls``, gathering no class in one task.

    ``pieces`` is a stored table, and has a ``row`` number in it. Rows are dealt to buckets by that number, so
    copies of one document part, and the buckets' counts are summed in two levels."""
    most = max(counts.values(), default=0)
    buckets = max(1, -(-most // BUCKET_ROWS))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets))).withColumn("shelf", F.floor(F.col("bucket") / BUCKET_ROWS))
    inside = keyed.withColumn("k", F.row_number().over(Window.partitionBy("cls", "bucket").orderBy("row")) - 1)
    sizes = keyed.groupBy("cls", "shelf", "bucket").agg(F.count(F.lit(1)).alias("n"))
    shelves = sizes.groupBy("cls", "shelf").agg(F.sum("n").alias("n"))
    ahead = shelves.select("cls", "shelf", (F.sum("n").over(Window.partitionBy("cls").orderBy("shelf")) - F.col("n")).alias("ahead"))
    before = sizes.join(ahead, ["cls", "shelf"])
    before = before.select("cls", "bucket", (F.col("ahead") + F.sum("n").over(Window.partitionBy("cls", "shelf").orderBy("bucket")) - F.col("n")).alias("before"))
    return inside.join(before, ["cls", "bucket"]).withColumn("rank", F.col("before") + F.col("k"))


def pack_documents(docs: DataFrame, path: str, *, end_id: int, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece."""
    spark = docs.sparkSession
    cls = F.when(F.col("length") == capacity, F.lit(0)).otherwise(F.ceil(F.col("length") / grain)).cast("int")
    pieces = materialize(spark, cut_documents(docs, path, end_id=end_id, capacity=capacity).withColumn("cls", cls).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r.cls: r["count"] for r in pieces.groupBy("cls").count().collect()}  # one row per class
    present = sorted(c for c in counts if c)
    sizes, demand = np.array(present, np.int64), np.array([counts[c] for c in present], np.int64)
    # per class: the first rank of each pattern that holds it, the pattern's first sequence, items in it
    slots: dict[int, list[tuple[int, int, int]]] = {c: [] for c in present}
    ranks, base = dict.fromkeys(present, 0), 0
    for pattern, times in whole_patterns(sizes, demand, capacity // grain):
        for k in np.flatnonzero(pattern).tolist():
            c, n = present[k], int(pattern[k])
            slots[c].append((ranks[c], base, n))
            ranks[c] += n * times
        base += times
    tables = {c: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for c, rows in slots.items()}
    fulls = base

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rank = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            sequence, slot = fulls + rank, np.zeros(len(rank), np.int64)
            for c in np.unique(kind[kind > 0]).tolist():
                at = np.flatnonzero(kind == c)
                first, start, n = tables[c]
                e = np.searchsorted(first, rank[at], "right") - 1
                within = rank[at] - first[e]
                sequence[at] = start[e] + within // n[e]
                slot[at] = within % n[e]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:6], pa.array(sequence, pa.int64()), pa.array(slot, pa.int64())], [*batch.schema.names[:6], "sequence_id", "slot"]
            )

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ranked = rank_in_class(pieces, counts).select(*columns, "cls", "rank")
    placed = ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, cls int, sequence_id long, slot long")
    before = Window.partitionBy("sequence_id").orderBy(F.desc("cls"), "slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*columns, "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
