"""Near-duplicate documents: SetSketch registers, banded, judged by joint likelihood, verified.

A document's set of word shingles is sketched into ``REGISTERS`` registers
``floor(1 - log_b(x))``, ``x`` the least of exponential variates that a seeded hash gives the
set's elements: exponentially spaced truncated minima, mergeable by maximum. Registers are cut
into bands of ``BAND`` values; documents sharing a band meet in a bucket.

No bucket is expanded into all its pairs. Documents with equal sets are one class from the start.
A bucket is cut into parts by hash; its classes meet their part's leader, and those two leaders of
the whole bucket. Leaders come first in one order of all classes, so the buckets of a group of
copies share them and a class has a link or two, not one per bucket. Pairs that the joint
likelihood of their registers (cardinalities known) leaves possible are verified on full sets.
That settles buckets of up to three classes. Larger ones are settled once all their classes are
in one component - a link inside a component adds nothing. The others meet their best linked
class, and last, classes of different components meet in blocks, within neighbouring set sizes,
that keep only pairs the likelihood leaves possible. So every pair of a bucket is either verified, ruled out by its
registers, or inside one component.

A pair at the threshold is missed with probability (1 - J^BAND)^(REGISTERS / BAND), 6e-11 at 0.85;
the likelihood test rules out a true link at 16 nats, about 1e-8.

Defined results: texts without words and null texts have n_shingles 0 and stand alone; rows that
repeat a doc_id are documents of their own, with the same or another text; null doc_ids stand
alone (component_id null, kept); texts may have any length; an empty table gives an empty result;
columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, left_join_heavy, materialize, materialize_counted, text_or_empty
from .graph import connected_components, joined_components
from .shingles import WIDTH, mixed, shingle_sets

THRESHOLD = 85
#: Of the pipeline's stage: near-duplicate stages take a similarity of 0.8 or more.
STAGE_THRESHOLD = 80
REGISTERS = 128
BAND = 4
BASE = 1.001
RATE = 20.0
NATS = 16.0
#: Classes of one block when classes of different components meet.
BLOCK = 1_000
#: Parts that a bucket, or the classes that meet one leader, may be spread over.
SALTS = 256


def _multipliers(m: int) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, m + 1, dtype=np.uint64)
    return mixed(k * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1), mixed(k * np.uint64(0xD1342543DE82EF95))


def sketch(values: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Registers of a set of 64-bit hashes, as unsigned 16-bit integers."""
    times, plus = _multipliers(m)
    least = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(values), 2048):
        part = values[low : low + 2048]
        np.minimum(least, (part[:, None] * times + plus).min(0), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype("<u2")


def merge_sketches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(more: np.ndarray, less: np.ndarray, same: np.ndarray, na: np.ndarray, nb: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of Jaccard similarity ``j``, given how many registers of a are above, below and equal to b's."""
    u, v = na / (na + nb), nb / (na + nb)
    up, down = _p(u - v * j), _p(v - u * j)
    return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))


def possible(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether similarity ``threshold`` or more is within ``NATS`` of the best; rows of registers."""
    if not len(ra):
        return np.zeros(0, bool)
    more, same = (ra > rb).sum(-1), (ra == rb).sum(-1)
    less = ra.shape[-1] - more - same
    na, nb = na.astype(np.float64), nb.astype(np.float64)
    top = np.minimum(na, nb) / np.maximum(na, nb)
    fits = top >= threshold
    best = np.full(len(more), -np.inf)
    good = best.copy()
    for share in np.linspace(0, 1, 65):
        j = top * share
        value = log_likelihood(more, less, same, na, nb, j)
        best = np.maximum(best, value)
        good = np.where(j >= threshold, np.maximum(good, value), good)
    good = np.maximum(good, log_likelihood(more, less, same, na, nb, np.minimum(top, threshold)))
    return fits & (np.maximum(best, good) - good <= NATS)


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash, n_shingles, h1, h2 (hashes of the whole set), registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(2).to_pylist(), width)
            with np.errstate(over="ignore"):
                h1 = [int(np.bitwise_xor.reduce(mixed(s))) if len(s) else 0 for s in sets]
                h2 = [int(mixed(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array(h1, np.uint64).view(np.int64)),
                    pa.array(np.array(h2, np.uint64).view(np.int64)),
                    pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "text_hash", "n_shingles", "h1", "h2", "registers"],
            )

    return _texts(docs).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, registers binary")


def _texts(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def full_sets(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """cls, shingles (sorted distinct hashes) of cls, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["cls", "shingles"])

    return texts.select("cls", "text").mapInArrow(run, "cls long, shingles array<long>")


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), -1)


def _beside_leaders(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` (cls, leader) with both ends' ``columns`` of ``table``, marked 1 and 2.

    A leader's row goes to at most ``SALTS`` places, however many classes meet it."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int"))
    one = table.select("cls", *[F.col(c).alias(f"{c}1") for c in columns])
    two = table.select(F.col("cls").alias("leader"), *[F.col(c).alias(f"{c}2") for c in columns])
    return salted.join(one, "cls").join(salted.select("leader", "salt").distinct().join(two, "leader"), ["leader", "salt"])


def _plausible(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """The pairs that their registers leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = possible(_registers(batch.column(4)), _registers(batch.column(5)), batch.column(2).to_numpy(), batch.column(3).to_numpy(), threshold / 100)
            yield batch.select([0, 1]).filter(pa.array(keep))

    joined = _beside_leaders(pairs, classes, ["n_shingles", "registers"])
    return joined.select("cls", "leader", "n_shingles1", "n_shingles2", "registers1", "registers2").mapInArrow(run, "cls long, leader long")


def _verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, threshold: int) -> tuple[DataFrame, int]:
    """Links (a, b) and how many: the distinct pairs (cls, leader) whose full sets are similar enough, registers first."""
    spark = pairs.sparkSession
    met = materialize(spark, pairs.where("cls <> leader").distinct(), "pairs")
    left = materialize(spark, _plausible(met, classes, threshold), "plausible")
    both = F.size(F.array_intersect("shingles1", "shingles2"))
    sized = _beside_leaders(left, sets, ["shingles"]).select("cls", "leader", both.alias("both"), (F.size("shingles1") + F.size("shingles2")).alias("all"))
    similar = sized.where(100 * F.col("both") >= threshold * (F.col("all") - F.col("both")))
    links, n = materialize_counted(spark, similar.select(F.least("cls", "leader").alias("a"), F.greatest("cls", "leader").alias("b")).distinct(), "links")
    drop_materialized(spark, met, left)
    return links, n


def _with_group(rows: DataFrame, by: list[str], per_group: DataFrame) -> DataFrame:
    """``rows`` (by, salt, ...) with the columns of ``per_group`` (by, ...): a large group's rows stay spread by salt."""
    places = rows.select(*by, "salt").distinct().join(per_group, by)
    return rows.join(places, [*by, "salt"])


def least_equal(m: int, threshold: float, chance: float = 1e-10) -> int:
    """Fewer equal registers than this have at most ``chance`` at ``threshold`` (equal minima alone, binomial)."""
    total = 0.0
    for k in range(m + 1):
        total += math.comb(m, k) * threshold**k * (1 - threshold) ** (m - k)
        if total > chance:
            return k
    return m


def _across_blocks(open_rows: DataFrame, classes: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) that join different components, among classes whose buckets hang together.

    Classes connected through open buckets form clusters. Similarity bounds the ratio of sizes, so a
    cluster is cut into levels of set size, and only equal and neighbouring levels meet; a level is cut into blocks by
    hash, and a task holds two blocks with registers and full sets. A pair is skipped once its components are joined in the
    task, ruled out by its registers, or verified; only links that join components come out."""
    spark = open_rows.sparkSession
    chief = open_rows.groupBy("key").agg(F.min(_draw()).alias("m")).select("key", F.col("m.cls").alias("chief"))
    cluster = connected_components(_with_group(open_rows, ["key"], chief).select(F.col("cls").alias("a"), F.col("chief").alias("b")))
    rows = open_rows.select("cls", "component", "salt").distinct().join(cluster.select(F.col("id").alias("cls"), F.col("component").alias("key")), "cls")
    # a little wider than the ratio, so that rounding keeps neighbours
    level = F.floor(F.log("n_shingles") / (1.000001 * math.log(100 / threshold))).cast("int")
    rows = rows.join(classes.select("cls", level.alias("level")), "cls")
    sizes = rows.groupBy("key", "level").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    # level l meets l and l + 1
    above = sizes.select("key", (F.col("level") - 1).alias("level"), F.col("parts").alias("above"))
    below = sizes.select("key", (F.col("level") + 1).alias("level"), F.col("parts").alias("below"))
    plan = sizes.join(above, ["key", "level"], "left").join(below, ["key", "level"], "left").na.fill(0, ["above", "below"])
    rows = _with_group(rows, ["key", "level"], plan).withColumn("part", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("parts")).cast("int"))
    rows = materialize(spark, rows.join(classes.select("cls", "registers"), "cls").join(sets, "cls"), "blocks")
    columns = ["cls", "component", "registers", "shingles"]

    def copies(n: str, shift: int, mine: bool) -> DataFrame:
        """Rows once per block they meet: as the lower block (``mine``) or as the upper one."""
        spread = rows.where(f"{n} > 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
        own, met = F.struct("level", "part"), F.struct((F.col("level") + shift).alias("level"), F.col("other").alias("part"))
        if shift == 0:
            spread = spread.where("part <= other" if mine else "other < part")
        low, high = (own, met) if mine else (met, own)
        return spread.select("key", low.alias("p1"), high.alias("p2"), *columns)

    left = copies("parts", 0, True).unionByName(copies("above", 1, True))
    right = copies("parts", 0, False).unionByName(copies("below", -1, False))
    fewest = least_equal(REGISTERS, threshold / 100)

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not len(one):
            return none
        same = one["p1"][0].as_py() == one["p2"][0].as_py()
        if same:
            two = one
        if not len(two):
            return none
        (ca, ka, ra, sa), (cb, kb, rb, sb) = (
            (t["cls"].to_numpy(), t["component"].to_numpy(), _registers(t["registers"].combine_chunks()), t["shingles"].combine_chunks()) for t in (one, two)
        )
        set_a, set_b = ([x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in s] for s in (sa, sb))
        na, nb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (set_a, set_b))
        parent: dict[int, int] = {}

        def find(k: int) -> int:
            while (p := parent.get(k, k)) != k:
                parent[k] = k = parent.get(p, p)
            return k

        out_a, out_b = [], []
        for i in range(len(ca)):
            near = np.flatnonzero((kb != ka[i]) & ((cb > ca[i]) | (not same)) & (np.minimum(nb, na[i]) * 100 >= threshold * np.maximum(nb, na[i])))
            near = near[(rb[near] == ra[i]).sum(1) >= fewest]
            near = near[possible(np.broadcast_to(ra[i], (len(near), ra.shape[1])), rb[near], np.full(len(near), na[i]), nb[near], threshold / 100)]
            for j in near.tolist():
                p, q = find(int(ka[i])), find(int(kb[j]))
                if p == q:
                    continue
                both = len(np.intersect1d(set_a[i], set_b[j], assume_unique=True))
                if 100 * both >= threshold * (na[i] + nb[j] - both):
                    parent[max(p, q)] = min(p, q)
                    out_a.append(min(ca[i], cb[j]))
                    out_b.append(max(ca[i], cb[j]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    on = ["key", "p1", "p2"]
    return left.groupBy(*on).cogroup(right.toDF(*right.columns).groupBy(*on)).applyInArrow(meet, "a long, b long")


def _draw() -> F.Column:
    """The order in which classes lead: the same in every bucket, so that buckets of one group share their leaders."""
    return F.struct(F.xxhash64("cls").alias("h"), F.col("cls"))


def _grouped(docs: DataFrame, threshold: int, width: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept: one row per document."""
    spark = docs.sparkSession
    sketched = materialize(spark, sketches(docs, width).withColumn("row", F.monotonically_increasing_id()), "sketches")
    # a class is named by its first row, not by a doc_id, which other texts may share
    classes = materialize(
        spark,
        sketched.where("n_shingles > 0 and doc_id is not null")
        .groupBy("h1", "h2", "n_shingles")
        .agg(F.min(F.struct("row", "doc_id", "text_hash", "registers")).alias("m"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
        .select("h1", "h2", "n_shingles", "copies", F.col("m.row").alias("cls"), "least", "m.doc_id", "m.text_hash", "m.registers"),
        "classes",
    )
    band = F.transform(
        F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)),
        lambda i: F.xxhash64(i, F.substring("registers", i * (2 * BAND) + 1, F.lit(2 * BAND))),
    )
    keyed = classes.select("cls", F.pmod(F.xxhash64("cls", F.lit(5)), F.lit(SALTS)).cast("int").alias("salt"), F.explode(band).alias("key"))
    # leaders of a bucket's parts, then of the bucket: no bucket, however large, meets in one task
    parts = keyed.groupBy("key", "salt").agg(F.count(F.lit(1)).alias("n"), F.min(_draw()).alias("x"))
    whole = parts.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"), F.min("x").alias("x"), F.max("x").alias("y")).where("n > 1")
    led = parts.select("key", "salt", F.col("x.cls").alias("own")).join(whole, "key").select("key", "salt", "own", "n", "parts", F.col("x.cls").alias("x"), F.col("y.cls").alias("y"))
    shared = materialize(spark, keyed.join(led, ["key", "salt"]), "shared")
    # full sets of every class that shares a bucket: all that any later step verifies
    needed = classes.join(shared.select("cls").distinct(), "cls", "left_semi").select("cls", "doc_id", "text_hash")
    sets = materialize(spark, full_sets(_texts(docs).join(needed, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]), width), "sets")

    leads = shared.where("cls = own")
    pairs = (
        shared.where("cls <> own").select("cls", F.col("own").alias("leader"))
        .unionByName(leads.select("cls", F.col("x").alias("leader"))).unionByName(leads.select("cls", F.col("y").alias("leader")))
    )
    links, _ = _verified(pairs, classes, sets, threshold)
    # settled: up to three classes, each its part's leader
    large = shared.where("n > 3 or n > parts").select("key", "salt", "cls")
    component = connected_components(links)
    for last in (False, True):
        # components are read by a plan of their own; only rows of buckets that hang in several meet them again
        placed = large.join(component.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        bounds = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        mixed_keys, n = materialize_counted(spark, bounds.where("lo <> hi").select("key"), "mixed")
        if not n:
            break
        held = _with_group(large, ["key"], mixed_keys).join(component.withColumnRenamed("id", "cls"), "cls", "left")
        open_rows = materialize(spark, held.select("key", "salt", "cls", F.coalesce("component", "cls").alias("component")), "open")
        if last:
            found, n = materialize_counted(spark, _across_blocks(open_rows, classes, sets, threshold), "links")
        else:
            degree = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count(F.lit(1)).alias("d"))
            ranked = open_rows.join(degree, "cls", "left").na.fill(0, ["d"])
            best = ranked.groupBy("key").agg(F.max(F.struct("d", "cls", "component")).alias("m")).select("key", F.col("m.cls").alias("leader"), F.col("m.component").alias("of"))
            found, n = _verified(_with_group(open_rows, ["key"], best).where("component <> of").select("cls", "leader"), classes, sets, threshold)
        if n:
            component = joined_components(component, found)
        drop_materialized(spark, mixed_keys, found, open_rows)
    # through the smallest doc_id of all classes of a component
    placed = classes.select("h1", "h2", "n_shingles", "copies", "least", "cls").join(component.withColumnRenamed("id", "cls"), "cls", "left")
    placed = materialize(spark, placed.withColumn("component", F.coalesce("component", "cls")), "placed")
    named = materialize(spark, placed.groupBy("component").agg(F.min("least").alias("root")), "roots")
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("h1"), F.lit(SALTS)).cast("int"))
    roots = materialize(spark, _with_group(salted, ["component"], named).select("h1", "h2", "n_shingles", "copies", "root"), "roots")
    joined = left_join_heavy(sketched.drop("registers"), roots, ["h1", "h2", "n_shingles"], "copies", sketched.count())
    out = joined.select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("root")), F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    drop_materialized(spark, shared, sets, links, placed, named)
    return out


def near_duplicates(docs: DataFrame, *, threshold: int = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document; ``threshold`` in hundredths."""
    return _grouped(docs, threshold, width).drop("text_hash")


def drop_duplicates(docs: DataFrame, *, threshold: int = STAGE_THRESHOLD, width: int = WIDTH) -> DataFrame:
    """One document of each group, with its own columns: the one of smallest doc_id.

    Rows that repeat a doc_id with the same text are one document; rows without doc_id all stay.
    Columns of any name are kept; only doc_id and text are read."""
    kept = _grouped(docs, threshold, width).where("kept and doc_id is not null").select("doc_id", "text_hash").distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"))
    named = packed.join(kept, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    left = named.select("row").unionByName(packed.where("doc_id is null").select("row"))
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])
