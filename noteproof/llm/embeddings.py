"""Embedding near-duplicates: a tree of nested centers, walked against itself.

Vectors are compared inside equal labels (and equal dimensions) by cosine in double precision.
Equal vectors form a class first, so copies cost one row. Classes descend a tree of nested centers:
a node above ``BLOCK`` classes draws some of them as centers, about ``FAN`` at most, its own among them, and each class
goes to the nearest; one exchange a level. Pairs of nodes descend together from the roots, and
a pair goes no further once the covering radii keep its nodes apart.
Leaves are split into blocks of about ``BLOCK``. Each surviving pair of blocks is one task: a cover
tree of nested levels with halving radii on either side, walked together. A pair of nodes is pruned
if even its nearest members are too far apart, counted as a whole if even its farthest are near
enough, and opened otherwise.

A task returns link counts per class and a spanning forest of its links, never all pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, or
whose label or vec_id is null, link with nothing (n_links 0, their own component; a null vec_id is kept);
repeated vec_ids are vectors of their own, with the same or another vector; columns other than vec_id,
embedding and label are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, left_join_heavy, materialize
from .graph import connected_components

THRESHOLD = 0.93
BLOCK = 2_000
#: Centers that a node of the tree draws, about, at most.
FAN = 64
#: Radii below this are leaves; their members are compared one by one.
LEAF_RADIUS = 1e-3
_SLACK = 1e-9


class Node:
    """Center row, covering radius, members' rows, and children unless a leaf."""

    __slots__ = ("center", "children", "members", "radius")

    def __init__(self, center: int, radius: float, members: np.ndarray):
        self.center, self.radius, self.members, self.children = center, radius, members, ()


def chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def cover_tree(x: np.ndarray) -> Node:
    """Nested cover tree of unit vectors: centers of a level are more than its radius apart."""
    rows = np.arange(len(x))
    root = Node(0, float(chord(x, x[:1]).max(initial=0)), rows)
    todo = [(root, 1.0)]
    while todo:
        node, radius = todo.pop()
        if len(node.members) <= 8 or node.radius <= LEAF_RADIUS:
            continue
        while radius >= node.radius:
            radius /= 2
        children, left = [], node.members
        left = np.concatenate([[node.center], left[left != node.center]])
        while len(left):
            d = chord(x[left], x[left[:1]])[:, 0]
            d[0] = 0
            inside = d <= radius
            child = Node(int(left[0]), float(d[inside].max()), left[inside])
            children.append(child)
            todo.append((child, radius / 2))
            left = left[~inside]
        node.children = tuple(children)
    return root


def dual_links(x: np.ndarray, y: np.ndarray, same: bool, threshold: float, wx: np.ndarray, wy: np.ndarray):
    """Weighted link counts of rows of x and of y, and a spanning forest of the links.

    ``same``: x is y, and a row doesn't link with itself."""
    reach = math.sqrt(2 - 2 * threshold)
    nx, ny = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    forest: list[tuple[np.ndarray, np.ndarray]] = []
    tx = cover_tree(x)
    ty = tx if same else cover_tree(y)
    todo = [(tx, ty)]
    while todo:
        a, b = todo.pop()
        if not a.children and not b.children:
            near = x[a.members] @ y[b.members].T >= threshold
            if same and a is b:
                np.fill_diagonal(near, False)
            if near.any():
                nx[a.members] += near @ wy[b.members]
                if not (same and a is b):
                    ny[b.members] += wx[a.members] @ near
                i, j = np.nonzero(near)
                forest.append((a.members[i], b.members[j]))
            continue
        split_a = a.children and (not b.children or a.radius >= b.radius)
        if same and a is b:
            kids = a.children
            c = np.array([k.center for k in kids])
            r = np.array([k.radius for k in kids])
            d = chord(x[c], x[c])
            todo += [(k, k) for k in kids]
            i, j = np.nonzero(np.triu(d <= r[:, None] + r[None, :] + reach + _SLACK, 1))
            pairs = [(kids[p], kids[q], d[p, q]) for p, q in zip(i.tolist(), j.tolist(), strict=True)]
        else:
            left = a.children if split_a else (a,)
            right = b.children if not split_a else (b,)
            ca, cb = np.array([k.center for k in left]), np.array([k.center for k in right])
            ra, rb = np.array([k.radius for k in left]), np.array([k.radius for k in right])
            d = chord(x[ca], y[cb])
            i, j = np.nonzero(d <= ra[:, None] + rb[None, :] + reach + _SLACK)
            pairs = [(left[p], right[q], d[p, q]) for p, q in zip(i.tolist(), j.tolist(), strict=True)]
        for p, q, d in pairs:
            if d + p.radius + q.radius < reach - _SLACK:
                nx[p.members] += wy[q.members].sum()
                ny[q.members] += wx[p.members].sum()
                forest.append((np.concatenate([p.members, np.full(len(q.members) - 1, p.members[0])]), np.concatenate([np.full(len(p.members), q.members[0]), q.members[1:]])))
            else:
                todo.append((p, q))
    if same:
        nx += ny
    return nx, ny, forest


def _spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) join two parts not joined before."""
    parent: dict[int, int] = {}

    def find(k: int) -> int:
        while (p := parent.get(k, k)) != k:
            parent[k] = k = parent.get(p, p)
        return k

    keep = np.zeros(len(a), bool)
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        p, q = find(i), find(j)
        if p != q:
            parent[max(p, q)] = min(p, q)
            keep[k] = True
    return keep


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit_classes(vectors: DataFrame) -> DataFrame:
    """One row per (label, vector): least (its smallest vec_id), n, label, dim, unit, e."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.size(e) == F.size(F.filter(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    grouped = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"), "label")
        .where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("e") > 0) & sound)
        .groupBy("label", "e")
        .agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    )
    # scaled by the largest component first, so that squares neither overflow nor vanish
    top = F.aggregate("e", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v)))
    scaled = grouped.withColumn("top", top).where("top > 0").withColumn("e1", F.transform("e", lambda v: v / F.col("top")))
    norm = F.sqrt(F.aggregate("e1", F.lit(0.0), lambda a, v: a + v * v))
    return scaled.withColumn("norm", norm).select(
        "least", "n", "label", F.size("e").alias("dim"), F.transform("e1", lambda v: v / F.col("norm")).alias("unit"), "e"
    )


def _nearest(left: pa.Table, right: pa.Table) -> pa.Table:
    """Each class (left) with the nearest of its node's centers (right)."""
    none = pa.table({"node": pa.array([], pa.int64()), "parent": pa.array([], pa.int64()), "cls": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
    if not len(left) or not len(right):
        return none
    x, center = _matrix(left["unit"]), _matrix(right["unit"])
    at, d = np.zeros(len(x), np.int64), np.zeros(len(x))
    for low in range(0, len(x), 4096):
        gap = chord(x[low : low + 4096], center)
        at[low : low + 4096] = gap.argmin(1)
        d[low : low + 4096] = gap.min(1)
    return pa.table({"node": right["center"].to_numpy()[at], "parent": left["node"], "cls": left["cls"], "d": d})


def center_tree(units: DataFrame, block: int, fan: int = FAN) -> tuple[DataFrame, list[DataFrame]]:
    """Leaf of each class (node, cls), and the levels of nodes, the roots first.

    ``units``: cls, label, dim, unit. A level holds node (the class at its center), parent, radius, rows, leaf, unit."""
    spark = units.sparkSession
    draw = F.struct(F.xxhash64("cls").alias("h"), F.col("cls"))
    root = units.groupBy("label", "dim").agg(F.min(draw).alias("m")).select("label", "dim", F.col("m.cls").alias("node"))
    at = units.select("cls", "label", "dim", F.pmod(F.xxhash64("cls", F.lit(4)), F.lit(64)).alias("salt"))
    roots = at.select("label", "dim", "salt").distinct().join(root, ["label", "dim"])
    placed = at.join(roots, ["label", "dim", "salt"]).select("node", F.col("node").alias("parent"), "cls", F.lit(2.0).alias("d"))
    placed = materialize(spark, placed, "placed")
    levels: list[DataFrame] = []
    leaves: list[DataFrame] = []
    before: DataFrame | None = None
    while True:
        nodes = placed.groupBy("node", "parent").agg(F.max("d").alias("radius"), F.count(F.lit(1)).alias("rows"))
        if before is None:
            nodes = nodes.withColumn("above", 2 * F.col("rows"))
        else:
            nodes = nodes.join(before.select(F.col("node").alias("parent"), F.col("rows").alias("above")), "parent")
        # a node that keeps nearly all of its parent's classes is a leaf: its vectors lie too close to part
        nodes = nodes.withColumn("leaf", (F.col("rows") <= block) | (10 * F.col("rows") > 9 * F.col("above")))
        nodes = nodes.join(units.select(F.col("cls").alias("node"), "unit"), "node").select("node", "parent", "radius", "rows", "leaf", "unit")
        nodes = materialize(spark, nodes, "nodes")
        levels.append(nodes)
        known = nodes.select("node", "rows", "leaf")
        salted = placed.withColumn("salt", F.pmod(F.xxhash64("cls", F.lit(4)), F.lit(64)))
        known = salted.select("node", "salt").distinct().join(known, "node")
        salted = salted.join(known, ["node", "salt"])
        leaves.append(materialize(spark, salted.where("leaf").select("node", "cls"), "leaves"))
        if not nodes.where("not leaf").limit(1).count():
            break
        chance = F.pmod(F.xxhash64("cls", F.lit(len(levels))), F.col("rows"))
        inner = salted.where("not leaf").join(units.select("cls", "unit"), "cls")
        parts = F.ceil(F.col("rows") / (4 * block)).cast("int")
        shards = inner.select("node", F.pmod(F.xxhash64("cls", F.lit(1)), parts).cast("int").alias("part"), "cls", "unit")
        # as many centers as the node has blocks, ``fan`` at most
        wanted = F.least(F.lit(fan), F.ceil(F.col("rows") / block))
        centers = inner.where((chance < wanted) | (F.col("cls") == F.col("node"))).select("node", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("cls").alias("center"), "unit")
        on = ["node", "part"]
        deeper = shards.groupBy(*on).cogroup(centers.toDF(*centers.columns).groupBy(*on)).applyInArrow(_nearest, "node long, parent long, cls long, d double")
        deeper = materialize(spark, deeper, "placed")
        drop_materialized(spark, placed)
        placed, before = deeper, nodes
    drop_materialized(spark, placed)
    leaf = leaves[0]
    for more in leaves[1:]:
        leaf = leaf.unionByName(more)
    return leaf, levels


def near_pairs(levels: list[DataFrame], reach: float) -> DataFrame:
    """Pairs (a, b) of leaves whose covering radii do not keep them apart, each once, a leaf with itself among them."""
    spark = levels[0].sparkSession
    pairs = levels[0].select(F.col("node").alias("a"), F.col("node").alias("b"), F.col("leaf").alias("la"), F.col("leaf").alias("lb"))
    done = [pairs.where("la and lb").select("a", "b")]
    pairs = pairs.where("not (la and lb)")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = {"a": pa.int64(), "b": pa.int64(), "la": pa.bool_(), "lb": pa.bool_()}
        if not len(left):
            return pa.table({k: pa.array([], t) for k, t in kinds.items()})
        own = left["a"][0].as_py() == left["b"][0].as_py()
        if own:
            right = left
        d = chord(_matrix(left["unit"]), _matrix(right["unit"]))
        near = d <= left["radius"].to_numpy()[:, None] + right["radius"].to_numpy()[None, :] + reach + _SLACK
        i, j = np.nonzero(np.triu(near) if own else near)
        x, y = left.take(pa.array(i)), right.take(pa.array(j))
        return pa.table({"a": x["node"], "b": y["node"], "la": x["leaf"], "lb": y["leaf"]})

    for k in range(1, len(levels)):
        # what a pair turns into on a side: the node's children, or a leaf itself
        stay = [x.where("leaf") for x in levels[:k]]
        sides = levels[k].select(F.col("parent").alias("from"), "node", "radius", "leaf", "unit")
        for x in stay:
            sides = sides.unionByName(x.select(F.col("node").alias("from"), "node", "radius", "leaf", "unit"))
        one = pairs.select("a", "b").join(sides.withColumnRenamed("from", "a"), "a")
        two = pairs.where("a <> b").select("a", "b").join(sides.withColumnRenamed("from", "b"), "b").select("a", "b", "node", "radius", "leaf", "unit")
        met = one.groupBy("a", "b").cogroup(two.toDF(*two.columns).groupBy("a", "b")).applyInArrow(meet, "a long, b long, la boolean, lb boolean")
        met = materialize(spark, met, "pairs")
        done.append(met.where("la and lb").select("a", "b"))
        pairs = met.where("not (la and lb)")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(vectors: DataFrame, *, threshold: float = THRESHOLD, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    spark = vectors.sparkSession
    reach = math.sqrt(2 - 2 * threshold)
    # a class is named by its row, not by a vec_id, which other vectors may share
    classes = materialize(spark, unit_classes(vectors).withColumn("cls", F.monotonically_increasing_id()), "classes")
    leaf, levels = center_tree(classes.select("cls", "label", "dim", "unit"), block, fan)
    rows = levels[0].select("node", F.when(F.col("leaf"), F.col("rows")).alias("rows"))
    for level in levels[1:]:
        rows = rows.unionByName(level.select("node", F.when(F.col("leaf"), F.col("rows")).alias("rows")))
    sizes = rows.where("rows is not null").select("node", F.ceil(F.col("rows") / block).cast("int").alias("blocks"))
    block_pairs = (
        near_pairs(levels, reach)
        .join(sizes.select(F.col("node").alias("a"), F.col("blocks").alias("na")), "a").join(sizes.select(F.col("node").alias("b"), F.col("blocks").alias("nb")), "b")
        .withColumn("ba", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("bb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .where("a <> b or ba <= bb").select("a", "ba", "b", "bb")
    )
    block_pairs = materialize(spark, block_pairs, "pairs")
    placed = leaf.join(sizes, "node").join(classes.select("cls", "n", "unit"), "cls")
    placed = materialize(spark, placed.select("node", F.pmod(F.xxhash64("cls", F.lit(2)), F.col("blocks")).cast("int").alias("at"), "cls", "n", "unit"), "cells")
    pair = ["a", "ba", "b", "bb"]
    first = block_pairs.join(placed.select(F.col("node").alias("a"), F.col("at").alias("ba"), "cls", "n", "unit"), ["a", "ba"])
    second = block_pairs.where("a <> b or ba <> bb").join(placed.select(F.col("node").alias("b"), F.col("at").alias("bb"), "cls", "n", "unit"), ["b", "bb"])

    def links(left: pa.Table, right: pa.Table) -> pa.Table:
        same = bool(len(left)) and left["a"][0].as_py() == left["b"][0].as_py() and left["ba"][0].as_py() == left["bb"][0].as_py()
        if not len(left) or not (same or len(right)):
            return pa.table({"cls": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        lx, x, wx = left["cls"].to_numpy(), _matrix(left["unit"]), left["n"].to_numpy()
        ly, y, wy = (lx, x, wx) if same else (right["cls"].to_numpy(), _matrix(right["unit"]), right["n"].to_numpy())
        nx, ny, forest = dual_links(x, y, same, threshold, wx, wy)
        a = np.concatenate([lx[i] for i, _ in forest]) if forest else np.zeros(0, np.int64)
        b = np.concatenate([ly[j] for _, j in forest]) if forest else np.zeros(0, np.int64)
        tree = _spanning(a, b)
        some_x, some_y = np.flatnonzero(nx), np.flatnonzero(ny) if not same else np.zeros(0, np.int64)
        counted = len(some_x) + len(some_y)
        return pa.table(
            {
                "cls": pa.array(np.concatenate([lx[some_x], ly[some_y], a[tree]]), pa.int64()),
                "links": pa.array(np.concatenate([nx[some_x], ny[some_y], np.zeros(int(tree.sum()), np.int64)]), pa.int64()),
                "other": pa.array([None] * counted + b[tree].tolist(), pa.int64()),
            }
        )

    found = first.groupBy(*pair).cogroup(second.toDF(*second.columns).groupBy(*pair)).applyInArrow(links, "cls long, links long, other long")
    found = materialize(spark, found, "links")
    drop_materialized(spark, block_pairs, placed)
    component = connected_components(found.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    linked = found.groupBy("cls").agg(F.sum("links").alias("outside"))
    known = classes.select("cls", "n", "least", "label", "e").join(linked, "cls", "left").join(component.withColumnRenamed("id", "cls"), "cls", "left")
    known = known.withColumn("component", F.coalesce("component", "cls")).withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(64)))
    known = materialize(spark, known, "known")
    # the smallest vec_id of a component, to its classes spread by salt
    roots = known.groupBy("component").agg(F.min("least").alias("root"))
    roots = known.select("component", "salt").distinct().join(roots, "component")
    known = known.join(roots, ["component", "salt"]).select("label", "e", "n", (F.coalesce("outside", F.lit(0)) + F.col("n") - 1).alias("links"), "root")
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    joined = left_join_heavy(own, materialize(spark, known, "known"), ["label", "e"], "n", vectors.count())
    # a null vec_id links with nothing, even where others have its vector
    return joined.withColumn("root", F.when(F.col("vec_id").isNotNull(), F.coalesce("root", "vec_id"))).select(
        "vec_id",
        F.when(F.col("vec_id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.col("root").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("root"), F.lit(True)).alias("kept"),
    )
