"""Verdict counts, trust scores, their waterfall, medians over votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severities in ascending order, verdict values, weights, penalties, caps, label bounds.
VERDICTS = ("verified", "partial", "no-evidence", "contradicted")
GENERATED_WEIGHT = 0.25
WITH_COMPLETENESS = (0.45, 0.25, 0.30)
WITHOUT_COMPLETENESS = (0.6, 0.4)
CRITICAL_PENALTY, WARN_PENALTY = 25, 10
CONTRADICTED_CAP, CRITICAL_CAP, UNVERIFIED_CAP = 35, 45, 65
LABELS = ((85, "solid"), (65, "minor gaps"), (45, "questionable"))


def verdict_counts(results: DataFrame, *keys: str) -> DataFrame:
    return results.groupBy(*keys).agg(*[F.count_if(F.col("verdict") == v).alias(v.replace("-", "_")) for v in VERDICTS])


def verdict_value() -> Column:
    return F.when(F.col("verdict") == "verified", 1.0).when(F.col("verdict") == "partial", 0.5).otherwise(0.0)


def score_label(score: Column) -> Column:
    out = F.when(score >= LABELS[0][0], LABELS[0][1])
    for bound, name in LABELS[1:]:
        out = out.when(score >= bound, name)
    return out.otherwise("suspicious")


def trust_scores(claims: DataFrame, files: DataFrame, flags: DataFrame, key: str, unverifiable: DataFrame | None = None) -> DataFrame:
    """correctness, completeness (null if any diff is unreadable), risk, overall, label per release.

    claims: key, verdict, generated and optionally kind; files: key, churn, covered, readable and
    optionally merge; flags: key, severity; unverifiable: key. Only claims of a change that were not
    skipped weigh; where a release is unverifiable, those without evidence drop out, and if any did, the
    score is capped and reads as unverified. Churn of merge commits counts nowhere."""
    counted = F.col("verdict") != "skipped"
    if "kind" in claims.columns:
        counted = counted & (F.col("kind") == "change")
    shaped = claims.withColumn("excused", F.lit(False))
    if unverifiable is not None:
        shaped = claims.join(unverifiable.select(key).distinct().withColumn("excused", F.lit(True)), key, "left").na.fill(False, ["excused"])
    dropped = counted & F.col("excused") & (F.col("verdict") == "no-evidence")
    weight = F.when(counted & ~dropped, F.when(F.col("generated"), GENERATED_WEIGHT).otherwise(1.0)).otherwise(0.0)
    right = shaped.groupBy(key).agg(
        F.sum(weight * verdict_value()).alias("points"),
        F.sum(weight).alias("weight"),
        F.max((F.col("verdict") == "contradicted").cast("int")).alias("contradicted"),
        F.count_if(dropped).alias("dropped"),
    )
    if "merge" in files.columns:
        files = files.where(~F.coalesce("merge", F.lit(False)))
    cover = files.groupBy(key).agg(
        F.sum("churn").alias("churn"),
        F.sum(F.when(F.col("covered"), F.col("churn")).otherwise(0)).alias("covered"),
        F.min(F.col("readable").cast("int")).alias("readable"),
    )
    flagged = flags.groupBy(key).agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warn").alias("warn"))
    joined = cover.join(right, key, "full").join(flagged, key, "left").na.fill(0, ["critical", "warn", "dropped"])
    correctness = F.when(F.col("weight") > 0, F.round(100 * F.col("points") / F.col("weight"))).otherwise(100.0)
    completeness = F.when(F.col("readable") == 1, F.when(F.col("churn") > 0, F.round(100 * F.col("covered") / F.col("churn"))).otherwise(100.0))
    risk = F.greatest(F.lit(0.0), 100.0 - CRITICAL_PENALTY * F.col("critical") - WARN_PENALTY * F.col("warn"))
    parts = joined.select(key, "contradicted", "critical", "dropped", correctness.alias("correctness"), completeness.alias("completeness"), risk.alias("risk"))
    a, b, c = WITH_COMPLETENESS
    d, e = WITHOUT_COMPLETENESS
    blend = F.when(F.col("completeness").isNull(), F.round(d * F.col("correctness") + e * F.col("risk"))).otherwise(
        F.round(a * F.col("correctness") + b * F.col("completeness") + c * F.col("risk"))
    )
    capped = F.when(F.col("contradicted") == 1, F.least(blend, F.lit(CONTRADICTED_CAP))).when(F.col("critical") > 0, F.least(blend, F.lit(CRITICAL_CAP))).otherwise(blend)
    hidden = F.col("dropped") > 0
    parts = parts.withColumn("overall", F.when(hidden, F.least(capped, F.lit(UNVERIFIED_CAP))).otherwise(capped))
    label = F.when(hidden, "unverified").otherwise(score_label(F.col("overall")))
    return parts.select(key, *[F.col(x).cast("long").alias(x) for x in ("correctness", "completeness", "risk", "overall")], label.alias("label"))


def waterfall(scores: DataFrame, key: str) -> DataFrame:
    """Steps from 100 down to the final score: one row per component, running total."""
    lost = lambda c, w: -F.round(w * (100 - F.coalesce(F.col(c), F.lit(100))), 2)
    a, b, c = WITH_COMPLETENESS
    steps = F.array(
        *[F.struct(F.lit(k).alias("step"), F.lit(n).alias("label"), d.alias("delta")) for k, (n, d) in enumerate((
            ("start", F.lit(100.0)), ("correctness", lost("correctness", a)), ("completeness", lost("completeness", b)), ("risk", lost("risk", c)),
        ))]
    )
    rows = scores.select(key, F.explode(steps).alias("s")).select(key, "s.*")
    from pyspark.sql import Window

    running = F.sum("delta").over(Window.partitionBy(key).orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(key, "step", "label", "delta", F.round(running, 2).alias("total"))


def severity() -> Column:
    out = F.when(F.col("verdict") == VERDICTS[0], 0)
    for k, v in enumerate(VERDICTS[1:], 1):
        out = out.when(F.col("verdict") == v, k)
    return out


def resolve_votes(votes: DataFrame, key: str) -> DataFrame:
    """The stricter-middle median by severity; contradicted needs a second voter.

    A lone contradicted vote gives way to the strictest of the others."""
    ranked = votes.groupBy(key).agg(F.array_sort(F.collect_list(severity())).alias("v"))
    n = F.size("v")
    median = F.get("v", F.ceil((n - 1) / 2).cast("int"))
    others = F.filter("v", lambda x: x < 3)
    resolved = F.when((median == 3) & (n - F.size(others) < 2) & (F.size(others) > 0), F.array_max(others)).otherwise(median)
    names = F.array(*[F.lit(x) for x in VERDICTS])
    return ranked.select(key, n.cast("long").alias("votes"), F.get(names, median).alias("median"), F.get(names, resolved).alias("resolved"))


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(value))
    return rows.groupBy(key).agg(ordered.alias("v")).select(key, F.get("v", F.floor(F.size("v") / 2).cast("int")).alias("upper_median"))
