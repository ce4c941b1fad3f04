"""Trie of conversations that start with the same turns, built a block of levels at a time.

All conversations start in the root. A round takes the next ``BLOCK`` turns of the live ones - those that share their node with
others: each turn becomes a row with a hash of the node before the block and all turns from there, and rows are grouped by depth and hash. The
smallest conv_id of a group names its node. Groups of one are a chain of nodes that nothing else can join; they are unfolded in one step.
A turn is known by the SHA-256 of its role and text; texts are not moved after the first sort.

Nothing is summed from level to level. A conversation that names a node names all its nodes after that, so each node is counted once, at the
conversation that names it: a node's leaves and children are those of its members that name a leaf or a child of it, its saved tokens are its members' turns from it on
before they name their own.

Groups are made with partial sums, and rows meet their group by broadcast where the group holds a thousandth of them, so no
group has to fit in a task. Turns are numbered by a sort into ranges, so a conversation may span ranges; the conversations that end in a node are
joined to one string in pieces, one per range, and hashed piece after piece.

Defined results: rows without a conv_id belong to no conversation; null roles and texts are empty; null turns come first, and
turns of equal number go by role, then text, so repeated rows are repeated turns; conversations may have any number of turns; an empty table has no
nodes, not even a root; columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HEAVY, materialize, materialize_counted, range_numbered

#: Turns that one row carries into a round, and levels of a round.
BLOCK = 8
#: Nodes of a chain that one row is first unfolded to.
CHAIN = 4096
_EMPTY = hashlib.sha256(b"").hexdigest()
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0 in the conversation's order), key (SHA-256 of role and text), bytes (of the text)."""
    spark = conversations.sparkSession
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    rows = rows.withColumns({"key": key, "bytes": F.octet_length("text").cast("long")})
    held = range_numbered(spark, rows, order, "turns", ["conv_id", "key", "bytes"])
    # a conversation lies in few ranges, mostly one; in each it is one run of places
    spans = held.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    spans = materialize(spark, spans, "spans")
    # only a conversation that began in an earlier range has an offset: one of them a range at most
    wide = spans.groupBy("conv_id").agg(F.count(F.lit(1)).alias("ranges")).where("ranges > 1")
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = spans.join(wide, "conv_id", "left_semi").select("conv_id", "part", earlier.alias("offset")).where("offset is not null")
    placed = held.join(spans.select("conv_id", "part", "first"), ["conv_id", "part"]).join(F.broadcast(offsets), ["conv_id", "part"], "left").na.fill(0, ["offset"])
    return placed.select("conv_id", (F.col("place") - F.col("first") + F.col("offset")).alias("pos"), "key", "bytes")


def rebuilt(turns: DataFrame, head: Column, base: Column) -> DataFrame:
    """conv_id, n, pos, key, bytes: the first ``head`` (at most ``BLOCK``) turns of conversation ``base``, then the own turns after as many;
    one row without a pos for a conversation that is left without turns. ``head`` and ``base`` are made of conv_id."""
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    donors = sizes.select(base.alias("base")).distinct()
    heads = turns.where(F.col("pos") < BLOCK).join(donors.withColumnRenamed("base", "conv_id"), "conv_id", "left_semi")
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "key", "bytes"))).alias("turns"))
    joined = sizes.select("conv_id", "own", head.cast("int").alias("h"), base.alias("base")).join(heads, "base", "left")
    joined = joined.withColumn("turns", F.when(F.col("turns").isNotNull() & (F.col("h") > 0), F.slice("turns", F.lit(1), F.col("h"))))
    joined = joined.withColumn("given", F.greatest(F.lit(0), F.coalesce(F.size("turns"), F.lit(0))))
    joined = joined.withColumn("n", F.col("given") + F.greatest(F.lit(0).cast("long"), F.col("own") - F.col("h")))
    first = joined.select("conv_id", "n", F.explode("turns").alias("t")).select("conv_id", "n", "t.pos", "t.key", "t.bytes")
    moved = turns.join(joined.select("conv_id", "n", "h", "given"), "conv_id").where("pos >= h")
    rest = moved.select("conv_id", "n", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "key", "bytes")
    none = joined.where("n = 0").select("conv_id", "n", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("bytes"))
    return first.unionByName(rest).unionByName(none)


def _blocks(rows: DataFrame) -> DataFrame:
    """conv_id, block, n, turns: up to ``BLOCK`` turns a row, sorted by block so that a level reads its own."""
    spark = rows.sparkSession
    cut = rows.withColumn("block", F.coalesce(F.expr(f"pos div {BLOCK}"), F.lit(0).cast("long")))
    kept = F.when(F.col("pos").isNotNull(), F.struct("pos", "key", "bytes"))
    held = cut.groupBy("conv_id", "block").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(kept)).alias("turns"))
    return materialize(spark, held.sortWithinPartitions("block"), "blocks")


def _meet(rows: DataFrame, groups: DataFrame, on: list[str], total: int) -> DataFrame:
    """``rows`` with their group; groups of a thousandth of all rows (fewer than a thousand) are broadcast."""
    large = F.broadcast(groups.where(F.col("n_convs") * HEAVY > total))
    return rows.join(large, on).unionByName(rows.join(groups.where(F.col("n_convs") * HEAVY <= total), on))


def _joined_ends(ends: DataFrame) -> DataFrame:
    """depth, conv_id, ends_sha256 of ``ends`` (depth, node, member): members in ascending order, joined by commas, hashed."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted rows of one range: a string for each run of one node in a batch
        part, piece = TaskContext.get().partitionId(), 0
        for batch in batches:
            depth, node, member = (c.to_pylist() for c in batch.columns)
            low, out = 0, []
            for k in range(1, len(depth) + 1):
                if k == len(depth) or (depth[k], node[k]) != (depth[low], node[low]):
                    out.append((depth[low], node[low], part, piece, ",".join(map(str, member[low:k]))))
                    low, piece = k, piece + 1
            yield pa.RecordBatch.from_pylist([dict(zip(("depth", "conv_id", "part", "piece", "ids"), r, strict=True)) for r in out], schema)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # pieces of a node follow each other; the hash goes on from batch to batch
        held, digest, done = None, None, []
        for batch in batches:
            for depth, node, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 4)), strict=True):
                if (depth, node) == held:
                    digest.update(b"," + ids.encode())
                    continue
                if held:
                    done.append((*held, digest.hexdigest()))
                held, digest = (depth, node), hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(("depth", "conv_id", "ends_sha256"), r, strict=True)) for r in done])
                done = []
        if held:
            yield pa.RecordBatch.from_pylist([{"depth": held[0], "conv_id": held[1], "ends_sha256": digest.hexdigest()}])

    schema = pa.schema([("depth", pa.int64()), ("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int64()), ("ids", pa.string())])
    order = ["depth", "node", "member"]
    ranges = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = ranges.mapInArrow(strings, "depth long, conv_id long, part int, piece long, ids string")
    dealt = pieces.repartition("depth", "conv_id").sortWithinPartitions("depth", "conv_id", "part", "piece")
    return dealt.mapInArrow(hashes, "depth long, conv_id long, ends_sha256 string")


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in OUT))


def _prefixes(live: DataFrame) -> DataFrame:
    """conv_id, n, depth, prefix, saved: of each conversation one row for each turn of its block; ``prefix`` is a hash of
    the node before the block and of the turns up to there, ``saved`` the bytes of all turns up to there."""
    one = F.array(F.struct(F.encode(F.col("node").cast("string"), "UTF-8").alias("h"), F.col("saved").alias("s")))

    def on(held: Column, turn: Column) -> Column:
        last = F.element_at(held, -1)
        return F.array_append(held, F.struct(F.unhex(F.sha2(F.concat(last["h"], turn["key"]), 256)).alias("h"), (last["s"] + turn["bytes"]).alias("s")))

    chained = live.select("conv_id", "n", "depth", F.posexplode(F.slice(F.aggregate("turns", one, on), 2, BLOCK)).alias("k", "at"))
    return chained.select("conv_id", "n", (F.col("depth") + 1 + F.col("k")).alias("depth"), F.col("at.h").alias("prefix"), F.col("at.s").alias("saved"))


def shared_rows(blocks: DataFrame, root: int, longest: int, total: int) -> DataFrame:
    """conv_id, n, depth, node, longest, saved: the nodes that a conversation shares with others, from the root; ``longest`` has the turns of the longest
    member, ``saved`` the bytes of all turns down to the node. A round takes ``BLOCK`` levels at once."""
    spark = blocks.sparkSession
    zero = F.lit(0).cast("long")
    top = blocks.where("block = 0").select("conv_id", "n", zero.alias("depth"), F.lit(root).cast("long").alias("node"), F.lit(longest).cast("long").alias("longest"), zero.alias("saved"))
    found, here, block = top, top, 0
    while True:
        going = here.where(F.col("n") > block * BLOCK).join(blocks.where(F.col("block") == block).select("conv_id", "turns"), "conv_id")
        steps = _prefixes(going)
        # a hash alone tells nodes of one depth apart, as it holds the node before the block
        groups = steps.groupBy("depth", "prefix").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.max("n").alias("longest"))
        shared, n = materialize_counted(spark, groups.where("n_convs > 1"), f"shared-{block}")
        if not n:
            return found
        # the rows are stored too, so that no round depends on the plans of all before it
        met = materialize(spark, _meet(steps, shared, ["depth", "prefix"], total).select(*top.columns), f"rows-{block}")
        found = found.unionByName(met)
        block += 1
        here = met.where(F.col("depth") == block * BLOCK)


def trie_nodes(conversations: DataFrame, head: Column | None = None, base: Column | None = None) -> DataFrame:
    """One row per node: conv_id (the smallest member, with depth the node's name), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. ``head`` and ``base``, columns of conv_id: every conversation starts with that many turns of that one (``rebuilt``)."""
    spark = conversations.sparkSession
    turns = materialize(spark, turn_rows(conversations), "numbered")
    head = F.lit(0) if head is None else head
    base = F.col("conv_id") if base is None else base
    blocks = _blocks(rebuilt(turns, head, base))
    start = blocks.where("block = 0").agg(F.min("conv_id").alias("root"), F.count(F.lit(1)).alias("total"), F.max("n").alias("longest")).first()
    if not start.total:
        return _empty(spark)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    each, down = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("depth")
    rows = shared_rows(blocks, start.root, start.longest, start.total)
    rows = rows.withColumns({"last": F.max("depth").over(each), "parent": F.lag("node").over(down)})
    # a conversation that is the smallest of a node is the smallest of all nodes after it, so it names them
    names = F.col("node") == F.col("conv_id")
    rows = rows.withColumns(
        {
            "named": F.coalesce(F.min(F.when(names, F.col("depth"))).over(each), F.col("last") + 1),
            "before": F.max(F.when(~names, F.col("saved"))).over(each),
            "above": F.coalesce(F.lag("saved").over(down), zero),
            "ends": F.max(F.when((F.col("depth") == F.col("last")) & (F.col("longest") == F.col("n")), one)).over(each).isNotNull(),
        }
    )
    rows = materialize(spark, rows, "placed")
    # every node is counted at the conversation that names it: as a child, as a leaf, and by the turns that the others save
    child = (F.col("n") > F.col("depth")) & (F.col("named") <= F.col("depth") + 1)
    leaf = (F.col("n") > F.col("last")) | ((F.col("named") <= F.col("last")) & F.col("ends"))
    saved = F.when(F.col("depth") < F.col("named"), F.col("before") - F.col("above")).otherwise(zero)
    shared = rows.groupBy("depth", F.col("node").alias("conv_id")).agg(
        F.min("parent").alias("parent"),
        F.count(one).alias("n_convs"),
        F.max("longest").alias("n"),
        F.sum(child.cast("long")).alias("n_children"),
        F.sum(leaf.cast("long")).alias("n_leaves"),
        F.sum(saved).alias("saved_tokens"),
    )
    hashed = _joined_ends(rows.where("n = depth").select("depth", "node", F.col("conv_id").alias("member")))
    shared = shared.join(hashed, ["depth", "conv_id"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    own = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    # the node after the last shared one
    single = rows.where("depth = last and n > last").select(
        "conv_id",
        (F.col("depth") + 1).alias("depth"),
        F.col("node").alias("parent"),
        one.alias("n_convs"),
        "n",
        (F.col("n") > F.col("depth") + 1).cast("long").alias("n_children"),
        one.alias("n_leaves"),
        zero.alias("saved_tokens"),
        F.when(F.col("n") == F.col("depth") + 1, own).otherwise(F.lit(_EMPTY)).alias("ends_sha256"),
    )
    steps = single.where("n > depth").select("conv_id", "n", "depth", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - depth - 1) div {CHAIN}"))).alias("k"))
    low, high = F.expr(f"depth + 1 + k * {CHAIN}"), F.expr(f"least(n, depth + (k + 1) * {CHAIN})")
    chain = steps.select("conv_id", "n", F.explode(F.sequence(low, high)).alias("depth"))
    chain = chain.select(
        "conv_id",
        "depth",
        F.col("conv_id").alias("parent"),
        one.alias("n_convs"),
        "n",
        (F.col("n") > F.col("depth")).cast("long").alias("n_children"),
        one.alias("n_leaves"),
        zero.alias("saved_tokens"),
        F.when(F.col("n") == F.col("depth"), own).otherwise(F.lit(_EMPTY)).alias("ends_sha256"),
    )
    found = shared.unionByName(single).unionByName(chain)
    return found.withColumnRenamed("parent", "parent_conv_id").select(*OUT)
