"""Pareto fronts on any number of axes: local fronts first, then only cells of the grid that may hold a better point are compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stored import stored

#: Cells per axis, and points of one block that a pair of tasks compares.
CELLS, BLOCK = 4, 2_000


def front(points: np.ndarray) -> np.ndarray:
    """Which rows no other row matches everywhere and beats somewhere; larger is better. Equal rows stand together."""
    kept = np.zeros(len(points), bool)
    found = np.zeros((0, points.shape[1]))
    # a point that beats another has the larger sum
    for k in np.argsort(-points.sum(1), kind="stable").tolist():
        p = points[k]
        if not ((found >= p).all(1) & (found > p).any(1)).any():
            kept[k] = True
            found = np.vstack([found, p])
    return kept


def beaten(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of ``points`` one of ``others`` matches everywhere and beats somewhere."""
    out = np.zeros(len(points), bool)
    for q in others:
        out |= (q >= points).all(1) & (q > points).any(1)
    return out


def pareto(rows: DataFrame, axes: list[str]) -> DataFrame:
    """The distinct values of ``axes`` (doubles, larger is better) on the front of ``rows``; rows with a null or NaN axis stand in no comparison.

    Fronts of partitions are taken first. Quantiles cut each axis into ``CELLS``; a cell below another on every axis is gone as a whole, and
    the blocks of a cell meet only blocks of cells that are at least its equal on each axis."""
    spark, n = rows.sparkSession, len(axes)
    clean = rows.select(*[F.col(a).cast("double").alias(a) for a in axes]).where(" and ".join(f"{a} is not null and not isnan({a})" for a in axes))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, n))
        for batch in batches:
            held = np.unique(np.vstack([held, np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])]), axis=0)
            held = held[front(held)]
        yield pa.RecordBatch.from_arrays([pa.array(held[:, k]) for k in range(n)], axes)

    schema = ", ".join(f"{a} double" for a in axes)
    near = stored(clean.mapInArrow(local, schema).distinct(), "fronts")
    if near.isEmpty():
        return near
    edges = near.approxQuantile(axes, [k / CELLS for k in range(1, CELLS)], 0.01)
    cell = F.array(*[sum(((F.col(a) >= e).cast("int") for e in cuts), F.lit(0)) for a, cuts in zip(axes, edges, strict=True)])
    placed = near.withColumn("cell", cell)
    # CELLS ** n cells at most
    cells = np.array([r.cell for r in placed.select("cell").distinct().collect()])
    live = [tuple(c) for c in cells.tolist() if not (cells > np.array(c)).all(1).any()]
    reach = [(list(a), list(b)) for a in live for b in live if all(y >= x for x, y in zip(a, b, strict=True))]
    pairs = F.broadcast(spark.createDataFrame(reach, "cell array<int>, other array<int>"))
    packed = placed.join(F.broadcast(spark.createDataFrame([(list(c),) for c in live], "cell array<int>")), "cell")
    salt = F.pmod(F.xxhash64(*axes), F.lit(1 << 20))
    sizes = packed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    packed = packed.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(salt, F.ceil(F.col("n") / BLOCK)))
    blocks = stored(packed.groupBy("cell", "block").agg(F.collect_list(F.array(*axes)).alias("points")), "blocks")
    met = blocks.join(pairs, "cell").join(blocks.select(F.col("cell").alias("other"), F.col("points").alias("better")), "other")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for points, better in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.array(points)
                gone = own[beaten(own, np.array(better))]
                yield pa.RecordBatch.from_arrays([pa.array(gone[:, k]) for k in range(n)], axes)

    gone = met.select("points", "better").mapInArrow(compare, schema)
    return packed.select(*axes).join(gone.distinct(), axes, "left_anti")
