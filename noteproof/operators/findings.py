"""What of a release is read in detail: files scored and grouped by subsystem, a budget dealt top-down, texts cut to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Characters of one call, the least worth one, weights of file kinds, what a sensitive path adds.
PER_CALL, LEAST_CALL, SENSITIVE = 20_000, 4_000, 4
WEIGHTS = {"source": 3.0, "migrations": 3.0, "config": 2.5, "dependencies": 1.5, "ci/build": 1.5, "tests": 1.0, "assets": 0.5, "docs": 0.5}


def file_score(path: Column, churn: Column) -> Column:
    """Reading priority: churn weighed by the kind of file, sensitive paths raised."""
    weight = F.lit(1.0)
    for kind, w in WEIGHTS.items():
        weight = F.when(T.file_category(path) == kind, w).otherwise(weight)
    return weight * F.log2(2 + churn) + F.when(T.sensitive_category(path).isNotNull(), SENSITIVE).otherwise(0)


def plan_findings(files: DataFrame, budget: int) -> DataFrame:
    """release, subsystem, files, score, place, alloc: subsystems by score, the first given a whole call each while the budget lasts.

    files: release, path, additions, deletions, patch; files without a patch and changelogs are left out. A subsystem's place tells what those before it
    took, so no fold over a release is needed: all but the last that gets anything take a whole call."""
    read = files.where(F.col("patch").isNotNull() & ~F.col("path").rlike(T.CHANGELOG))
    scored = read.select("release", T.subsystem(F.col("path")).alias("subsystem"), file_score(F.col("path"), F.col("additions") + F.col("deletions")).alias("score"))
    groups = scored.groupBy("release", "subsystem").agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("score"), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("release").orderBy(F.desc("score"), "subsystem"))
    ranked = groups.withColumn("place", place.cast("long"))
    left = F.lit(budget) - PER_CALL * (F.col("place") - 1)
    return ranked.withColumn("alloc", F.when(left >= LEAST_CALL, F.least(F.lit(PER_CALL), left)).otherwise(0).cast("long"))


def cut_texts(texts: Column, budget: int) -> Column:
    """The first texts of an array whose lengths fill ``budget``; the one that goes beyond is cut and marked, and its mark counts, so what follows a cut is a fold."""
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, text: Column) -> Column:
        shown = T.truncated(text, F.lit(budget) - state["used"])
        return F.when(state["used"] >= budget, state).otherwise(
            F.struct((state["used"] + F.length(shown)).alias("used"), F.concat(state["out"], F.array(shown)).alias("out"))
        )

    return F.aggregate(texts, start, step)["out"]
