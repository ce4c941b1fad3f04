"""Connected components without gathering links: hooking to the least neighbour, contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, materialize, materialize_counted

#: Places that the links of one vertex are spread over when they look up where it went.
SALTS = 16
#: So many links, whatever the input, are followed to their ends in one task.
FEW = 10_000


def _rank(column: str) -> F.Column:
    """An order of the vertices that has nothing to do with their ids, so that chains contract fast."""
    return F.struct(F.xxhash64(column).alias("h"), F.col(column).alias("v"))


def _targets(rows: DataFrame, column: str, salt: str, hooks: DataFrame) -> DataFrame:
    """``column``, ``salt``, ``to``: the target in ``hooks`` (u, p) of each value, once per salt that ``rows`` have of it.

    So a frequent value is looked up in at most ``SALTS`` places, and no more copies are made than there are rows."""
    return rows.select(column, salt).distinct().join(hooks.select(F.col("u").alias(column), F.col("p").alias("to")), column)


def _moved(rows: DataFrame, hooks: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with ``columns`` replaced by their targets in ``hooks`` (u, p); a frequent value is split by salt."""
    salts = {c: F.pmod(F.xxhash64(*[o for o in rows.columns if o != c]), F.lit(SALTS)).cast("int").alias(f"{c}_salt") for c in columns}
    salted = rows.select("*", *salts.values())
    out = salted
    for c in columns:
        out = out.join(_targets(salted, c, f"{c}_salt", hooks).withColumnRenamed("to", f"{c}_to"), [c, f"{c}_salt"])
    return out.select(*[F.col(f"{c}_to").alias(c) if c in columns else c for c in rows.columns])


def _through(placed: DataFrame, hooks: DataFrame) -> DataFrame:
    """``placed`` (id, at) with ``at`` replaced by its target in ``hooks`` (u, p), if it has one."""
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return salted.join(_targets(salted, "at", "salt", hooks), ["at", "salt"], "left").select("id", F.coalesce("to", "at").alias("at"))


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, p of links (a, b) that are all in one task: the least vertex of its component."""
    parent: dict[int, int] = {}

    def find(k: int) -> int:
        while (p := parent.setdefault(k, k)) != k:
            parent[k] = k = parent[p]
        return k

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    names = sorted(parent)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([find(k) for k in names], pa.int64())], ["u", "p"])


def connected_components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id reachable over ``edges`` (a, b), for every id that has an edge.

    Each round every vertex hooks to its least neighbour, in a random order, and on to where that one
    hooks; links inside a tree vanish, the others run between trees and are kept once. Rounds are written to the
    shared folder, so neither lineage nor driver memory grows, and shrink geometrically; the last ``FEW`` links
    are followed in one task, which saves the rounds that would have next to no rows.
    Self-links, repeated and reversed links are allowed; rows with a null end are ignored; no
    edges give no rows.
    """
    spark = edges.sparkSession
    least_first = [F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")]
    links, n = materialize_counted(spark, edges.where("a <> b").select(*least_first).distinct(), "edges")
    rounds: list[DataFrame] = []
    while n > FEW:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min(_rank("v")).alias("m"))
        hooks = materialize(spark, least.select("u", F.least("m", _rank("u"))["v"].alias("p")), "least")
        jumped = materialize(spark, _moved(hooks, hooks, "p"), "hooks")
        after, n = materialize_counted(spark, _moved(links, jumped, "a", "b").where("a <> b").select(*least_first).distinct(), "edges")
        drop_materialized(spark, links, hooks)
        links = after
        rounds.append(jumped)
    if n:
        rounds.append(materialize(spark, links.coalesce(1).mapInArrow(_roots, "u long, p long"), "hooks"))
    drop_materialized(spark, links)
    if not rounds:
        return spark.createDataFrame([], "id long, component long")
    if n and len(rounds) == 1:
        return rounds[0].select(F.col("u").alias("id"), F.col("p").alias("component"))
    # later rounds first: each has fewer rows than the one before, and the first one's are read once
    while len(rounds) > 1:
        last = rounds.pop()
        earlier = rounds.pop()
        ends = _through(earlier.select(F.col("u").alias("id"), F.col("p").alias("at")), last)
        rounds.append(materialize(spark, ends.select(F.col("id").alias("u"), F.col("at").alias("p")), "hooks"))
        drop_materialized(spark, last, earlier)
    placed = rounds[0].select(F.col("u").alias("id"), F.col("p").alias("at"))
    least = placed.groupBy("at").agg(F.min("id").alias("p")).select(F.col("at").alias("u"), "p")
    # stored, as callers read it several times in one plan
    component = materialize(spark, _moved(placed, least, "at").select("id", F.col("at").alias("component")), "components")
    drop_materialized(spark, placed)
    return component


def joined_components(component: DataFrame, edges: DataFrame) -> DataFrame:
    """``component`` (id, component: its smallest id) once ``edges`` (a, b) are there, too: only components that they join are moved."""
    spark = component.sparkSession
    ends = edges.where("a <> b").select("a", "b")
    for end in ("a", "b"):
        of = component.select(F.col("id").alias(end), "component")
        ends = ends.join(of, end, "left").select(*[F.coalesce("component", c).alias(c) if c == end else c for c in ends.columns])
    ends = materialize(spark, ends, "ends")
    over = connected_components(ends)
    # an end that had no edge before has one in ``ends``, so its component is there
    alone = over.join(component.select("id"), "id", "left_anti")
    moved = _through(component.select("id", F.col("component").alias("at")), over.select(F.col("id").alias("u"), F.col("component").alias("p")))
    joined = materialize(spark, moved.select("id", F.col("at").alias("component")).unionByName(alone), "components")
    drop_materialized(spark, ends)
    return joined
