"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Native throughout: arrays, higher-order functions and one hash aggregate, no Python code
on the executors and no shuffle of text.

* Words are runs of characters other than space and U+0009-U+000D, taken from the whole text.
* Two multinomials over ``buckets`` hashed unigrams and bigrams are counted in one pass: the raw
  corpus over *every* document, the trusted target over a bounded sample of trusted labels
  (``max_trusted``, smallest hashes of doc_id first, so the sample is stable).
* A document scores the mean log ratio of its n-grams; it is kept from ``threshold`` upwards.

Defined results: null or empty text has no words, fails the base rules and scores null; texts of any
length are read whole; repeated rows are scored alike and all returned; a null doc_id is scored but never trusted; an empty table
gives an empty result; without trusted labels all weights are 0, so the base rules alone decide.
Columns of the input other than doc_id and text never take part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CLASS, text_or_empty

BUCKETS = 1 << 16
MAX_TRUSTED = 20_000
#: Kept from here: a text whose n-grams are on average 0.89 times as likely under the target as under the corpus.
#: On sf 0.1, past the base rules, labelled good texts score from -0.028 upwards and labelled bad ones up to -0.138.
THRESHOLD = -0.12
#: Pseudo-counts of a raw-corpus bucket; the target's are these times its share of all n-grams,
#: so a bucket too rare to judge weighs next to nothing.
SMOOTHING = 16

_SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression, so that lambdas do not recompute it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WS_CLASS), "")


def repeated_words(hashes: Column) -> Column:
    """Positions lying in a 3-word window that occurs twice or more; ``hashes``: one per word."""
    n = F.size(hashes)

    def windows(h):
        return F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))

    def starts(ws):
        ordered = F.array_sort(F.transform(ws, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(
            ordered,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(
                        F.transform(
                            s,
                            lambda x, k: F.struct(
                                x["i"].alias("i"),
                                (
                                    F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                                    | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
                                ).alias("r"),
                            ),
                        ),
                        lambda x: x["r"],
                    ),
                    lambda x: x["i"],
                )
            ),
        )

    def covered(p):
        zero = F.struct(F.lit(0).alias("total"), F.lit(-3).alias("last"))
        return F.aggregate(
            p,
            zero,
            lambda a, x: F.struct((a["total"] + F.least(F.lit(3), x - a["last"])).alias("total"), x.alias("last")),
            lambda a: a["total"],
        )

    def found_in(ws, dups):
        return F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: F.array_contains(dups, F.get(ws, i)))

    def repeated(ws):
        return let(
            F.array_sort(ws),
            lambda s: F.array_distinct(F.filter(s, lambda x, k: F.coalesce(F.get(s, k + 1) == x, F.lit(False)))),
        )

    # few repeated windows (most texts): look for them directly; many: one sort of all positions
    return F.when(n < 4, F.lit(0)).otherwise(
        let(
            windows(hashes),
            lambda ws: let(
                repeated(ws),
                lambda d: F.when(F.size(d) == 0, F.lit(0)).otherwise(
                    covered(F.when(F.size(d) <= 16, found_in(ws, d)).otherwise(starts(ws)))
                ),
            ),
        )
    )


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def with_hashes(text: Column, body) -> Column:
    """``body`` of the array of one 64-bit hash per word and of the words, both computed once for a row.

    Bound inside the expression rather than as a column: the optimizer copies a column's
    expression into filters it infers, and inside lambdas that would be once per word.
    """
    return let(words_of(text), lambda words: let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: body(h, words)))


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def ngram_buckets(h: Column, buckets: int) -> Column:
    """Bucket numbers of all unigrams, then of all bigrams."""
    uni = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
    bi = F.transform(
        F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))),
        lambda x, i: F.pmod(F.xxhash64(x, F.get(h, i + 1)), F.lit(buckets)).cast("int"),
    )
    return F.concat(uni, bi)


def trusted_ids(labels: DataFrame, max_trusted: int) -> DataFrame:
    ids = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)


def bucket_weights(docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """One row, one column ``w``: array of ``buckets`` log ratios, target over raw corpus."""
    spark = docs.sparkSession
    trusted = F.broadcast(trusted_ids(labels, max_trusted).withColumn("trusted", F.lit(1)))  # at most max_trusted rows
    counted = (
        texts(docs)
        .join(trusted, "doc_id", "left")
        .select(with_hashes(F.col("text"), lambda h, _: ngram_buckets(h, buckets)).alias("bs"), "trusted")
        .select(F.explode_outer("bs").alias("b"), "trusted")  # of a column: lambdas in a generator would stop code generation
        .where(F.col("b").isNotNull())
        .groupBy("b")
        .agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("target"))
    )
    full = spark.range(buckets).select(F.col("id").cast("int").alias("b")).join(counted, "b", "left").na.fill(0, ["raw", "target"])
    s = float(SMOOTHING)
    one = full.agg(
        F.sum("raw").alias("R"),
        F.sum("target").alias("T"),
        F.array_sort(F.collect_list(F.struct("b", "raw", "target"))).alias("rows"),
    )
    return one.select(
        F.when(
            F.col("T") > 0,
            F.transform(
                "rows",
                lambda x: F.log((x["target"] + s * F.col("T") / F.col("R")) / F.col("T")) - F.log((x["raw"] + s) / F.col("R")),
            ),
        )
        .otherwise(F.array_repeat(F.lit(0.0), buckets))
        .alias("w")
    )


def _judged(
    docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED, threshold: float = THRESHOLD
) -> DataFrame:
    """row (the document's own columns) and its measures and verdict."""
    weights = bucket_weights(docs, labels, buckets=buckets, max_trusted=max_trusted).scalar()
    text = F.col("text")
    measures = lambda w: with_hashes(
        text,
        lambda h, words: F.struct(
            F.size(h).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(h).cast("long").alias("n_repeat_words"),
            F.when(
                F.size(h) > 0,
                let(ngram_buckets(h, buckets), lambda b: F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(w, x)) / F.size(b)),
            ).alias("score"),
        ),
    )
    measured = (
        docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_or_empty().alias("text"))
        .select("*", weights.alias("w"))  # read once below, so the optimizer folds the subquery's value in there
        .select(
            "row",
            let(F.col("w"), measures).alias("m"),
            F.when(text.rlike(f"[{_SYMBOLS}]"), F.length(text) - F.length(F.translate(text, _SYMBOLS, "")))
            .otherwise(F.lit(0))
            .cast("long")
            .alias("n_symbols"),
            duplicate_lines(text).cast("long").alias("n_dup_lines"),
        )
        .select("row", F.struct("m.*", "n_symbols", "n_dup_lines").alias("m"))
        # a generator's output is where filters stop: pushed further down they would compute m once per use
        .select("row", F.explode_outer(F.array("m")).alias("m"))
        .select("row", "m.*")
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumns(
        {"base_failed": failed, "kept": ~failed & (F.coalesce(F.col("score"), F.lit(float("-inf"))) >= F.lit(threshold))}
    )


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score."""
    judged = _judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, **options)
    return judged.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def filter_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents kept, with their own columns."""
    return _judged(docs, labels, **options).where("kept").select(*[F.col("row")[c].alias(c) for c in docs.columns])
