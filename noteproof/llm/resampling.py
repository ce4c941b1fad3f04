"""Importance resampling toward a target distribution.

A document's features are its runs of ``1..n`` consecutive words, hashed into buckets. Counts over all documents (the raw
side) and over all target texts give each bucket a whole-number gain; a document's weight is the sum of its features' gains, read from
one array. A Gumbel number drawn from the doc_id is added, and the documents of the highest scores are
drawn. The k-th key of (score, doc_id, n_features) is found by radix selection: each pass counts one digit of the rows that
share the digits found so far, so that no sort over all rows is needed; only drawn rows are sorted by range and ranked.

Words are runs of bytes above 0x7F, digits and letters, after A-Z became a-z.

Defined results: a null or empty text has no words, weight 0 and a score from its doc_id alone; a null doc_id counts as an empty one in the
random number and comes last among ties; repeated rows are scored and drawn each, and rows equal in all returned columns
are interchangeable, so the first of them take the last ranks; texts of any length are read whole; with no target texts gains come from the raw side alone; an empty table
gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, range_numbered

#: Bits of one radix digit, and so the most counters that a pass brings to the driver (2^12).
DIGIT_BITS = 12
_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased and no other letter."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(F.coalesce(low, F.lit("")), F.lit(_WORD), 0)


def bucket_arrays(words: Column, grams: int, buckets: int) -> Column:
    """The bucket of each run of 1 to ``grams`` words."""
    hashed = lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int")

    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: hashed(F.array_join(F.slice(words, i, F.lit(n)), " ")))

    return F.concat(F.transform(words, hashed), *[runs(n) for n in range(2, grams + 1)])


def bucket_counts(texts: DataFrame, grams: int, buckets: int) -> list[int]:
    """Features of all texts by bucket; ``buckets`` numbers come to the driver."""
    cells = texts.select(F.explode(bucket_arrays(words_of(F.col("text")), grams, buckets)).alias("bucket"))
    found = [0] * buckets
    for bucket, n in cells.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect():
        found[bucket] = n
    return found


def gains(raw: list[int], target: list[int]) -> list[int]:
    """By bucket: floor of 1000 times the log ratio of the smoothed target and raw shares, in doubles."""
    k, raw_all, target_all = len(raw), float(sum(raw)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (raw_all + k) / ((s + 1.0) * (target_all + k)))) for s, t in zip(raw, target, strict=True)]


def gumbel(doc_id: Column, seed: int) -> Column:
    """A whole number drawn from the doc_id: floor of -1000 ln(-ln u)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


def score_documents(docs: DataFrame, target: DataFrame, *, grams: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each row of ``docs`` (doc_id, text) against ``target`` (text)."""
    gain = gains(bucket_counts(docs, grams, buckets), bucket_counts(target, grams, buckets))
    held = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), bucket_arrays(F.col("words"), grams, buckets).alias("cells"))
    weight = F.aggregate("cells", F.lit(0).cast("long"), lambda total, b: total + F.get(held, b))
    rows = rows.select("doc_id", "n_words", F.size("cells").cast("long").alias("n_features"), weight.alias("weight"))
    return rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def _ordered(value: Column, descending: bool = False) -> Column:
    """A long as 64 bits whose unsigned order is the wanted one."""
    return F.bitwise_not(_ordered(value)) if descending else value.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def _digits(parts: list[Column]) -> list[Column]:
    """Digits of ``DIGIT_BITS`` bits, the most significant first, of 64-bit parts."""
    out = []
    for part in parts:
        for top in range(64, 0, -DIGIT_BITS):
            low = max(0, top - DIGIT_BITS)
            out.append(F.shiftrightunsigned(part, low).bitwiseAND(F.lit((1 << (top - low)) - 1).cast("long")).cast("int"))
    return out


def kth_key(rows: DataFrame, parts: list[Column], k: int) -> tuple[list[Column], list[int], int, int]:
    """Radix selection of the ``k``-th smallest key: its digit columns, its leading digits, how many rows come before all keys that share them, and how many share them.

    A pass counts one digit among the rows of the prefix found so far; passes end once all rows of a prefix are taken together or the key is complete."""
    digits, prefix, before, same = _digits(parts), [], 0, None
    for digit in digits:
        left = rows
        for d, value in zip(digits, prefix, strict=False):
            left = left.where(d == value)
        counts = sorted(left.groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n")).collect())
        for value, n in counts:
            if before + n >= k:
                prefix.append(value)
                same = n
                break
            before += n
        if before + same == k:
            break
    return digits, prefix, before, same


def draw(scored: DataFrame, percent: int = 10, least_words: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score, rank: of the rows with ``least_words`` words the ``percent`` of highest scores, ranked; others have no rank."""
    spark = scored.sparkSession
    out = ["doc_id", "n_features", "weight", "score"]
    rows = materialize(spark, scored, "scored")
    able = rows.where(F.col("n_words") >= least_words)
    k = percent * able.count() // 100
    none = F.lit(None).cast("long").alias("rank")
    if k == 0:
        return rows.select(*out, none)
    doc_id = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    missing = F.col("doc_id").isNull().cast("long")
    parts = [_ordered(F.col("score"), True), _ordered(doc_id), _ordered(missing), _ordered(F.col("n_features"), True)]
    digits, prefix, before, same = kth_key(able, parts, k)
    shared = F.lit(True)
    sooner = F.lit(False)
    for d, value in zip(digits, prefix, strict=False):
        sooner = sooner | (shared & (d < value))
        shared = shared & (d == value)
    can = F.col("n_words") >= least_words
    whole = before + same == k
    drawn = rows.where(can & (sooner | shared if whole else sooner)).select(*out)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features")]
    numbered = range_numbered(spark, drawn, order, "drawn")
    # as many counts as partitions; a partition's offset is the rows before it
    sizes = sorted(numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = {}, 0
    for part, n in sizes:
        offsets[part], total = total, total + n
    table = spark.createDataFrame(list(offsets.items()) or [(0, 0)], "part int, earlier long")
    ranked = numbered.join(F.broadcast(table), "part").select(*out, (F.col("earlier") + F.col("place") + 1).alias("rank"))
    rest = rows.where(~(can & (sooner | shared))).select(*out, none)
    found = ranked.unionByName(rest)
    if not whole:
        # rows that agree in all columns: the key is complete, so they differ in nothing that is returned
        key = rows.where(can & shared).select(*out).first()
        schema = T.StructType([f for f in rows.select(*out).schema.fields])
        equal = spark.range(same).select(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(key, schema, strict=True)], F.col("id"))
        rank = F.when(F.col("id") < k - before, F.col("id") + before + 1)
        found = found.unionByName(equal.select(*out, rank.alias("rank")))
    return found


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 10, least_words: int = 20, grams: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; rank is null for those not drawn."""
    return draw(score_documents(docs, target, grams=grams, buckets=buckets, seed=seed), percent, least_words)
