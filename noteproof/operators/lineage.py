"""Histories of commits and tags, and stored reports held against rebuilt ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.notes import changelog_section
from ..stored import stored

#: Commits that a walk to the root passes at most: three pages of a hundred.
WALK = 300
#: Newest tags that are looked up in a changelog.
SCAN_TAGS = 200


def roots(commits: DataFrame, walk: int = WALK) -> DataFrame:
    """sha, root: the root commit of each commit's history, null where it is further than ``walk`` commits or is the commit itself.

    commits: sha, parent (the first; null for a root). Every round joins each commit's jump with the jump's own, so the walk takes as many
    rounds as its length has bits, for all commits at once."""
    # a jump goes up as far as it knows; one from a root stays there. A parent that is not in the table ends the walk unknown
    known = commits.select("sha", F.coalesce("parent", "sha").alias("to"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("steps"))
    reach = 1
    while reach < walk - 1:
        further = known.select(F.col("sha").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        joined = known.join(further, "to", "left")
        known = stored(joined.select("sha", F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "jumps")
        reach *= 2
    ends = commits.where("parent is null").select(F.col("sha").alias("to"), F.lit(True).alias("is_root"))
    found = F.when(F.coalesce("is_root", F.lit(False)) & F.col("steps").between(1, walk - 1), F.col("to"))
    return known.join(ends, "to", "left").select("sha", found.alias("root"))


def provable_releases(changelogs: DataFrame, tags: DataFrame, scan: int = SCAN_TAGS) -> DataFrame:
    """repo, tag, tagged_at, notes: of the ``scan`` newest tags of each repository those that are no prerelease and have a section in its changelog.

    changelogs: repo, text; tags: repo, tag, tagged_at. Of equal times the later name is newer."""
    age = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc_nulls_last("tagged_at"), F.desc("tag")))
    newest = tags.withColumn("age", age).where(F.col("age") <= scan).where(~T.is_prerelease_tag(F.col("tag")))
    asked = newest.groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("age", "tag", "tagged_at"))).alias("tags"))
    kind = {f.name: f.dataType.simpleString() for f in newest.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (repo, t["tag"], t["tagged_at"], notes)
                for repo, text, held in zip(pdf["repo"], pdf["text"], pdf["tags"], strict=True)
                for t in held
                if (notes := changelog_section(text or "", t["tag"])) is not None
            ]
            yield pd.DataFrame(rows, columns=["repo", "tag", "tagged_at", "notes"])

    met = changelogs.select("repo", "text").join(asked, "repo")
    return met.mapInPandas(run, f"repo {kind['repo']}, tag string, tagged_at {kind['tagged_at']}, notes string")


def compare_reports(kept: DataFrame, rebuilt: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """key, where (both, stored, rebuilt), moved, and per array field what is gone and what is new, in order.

    Both sides: key, and ``fields`` as arrays; one full outer join compares all fields of a report. A side that has no row, or a null field, has nothing in it."""
    a, b = kept.select(*key, F.struct(*fields).alias("_a")), rebuilt.select(*key, F.struct(*fields).alias("_b"))
    met = a.join(b, key, "full_outer")
    side = lambda s, f: F.coalesce(F.col(f"{s}.{f}"), F.array().cast(kept.schema[f].dataType))
    less = lambda x, y: F.array_sort(F.array_except(x, y))
    parts: list[Column] = []
    moved = F.lit(False)
    for f in fields:
        gone, new = less(side("_a", f), side("_b", f)), less(side("_b", f), side("_a", f))
        parts += [gone.alias(f"{f}_gone"), new.alias(f"{f}_new")]
        moved = moved | (F.size(gone) > 0) | (F.size(new) > 0)
    where = F.when(F.col("_a").isNull(), "rebuilt").when(F.col("_b").isNull(), "stored").otherwise("both")
    return met.select(*key, where.alias("where"), moved.alias("moved"), *parts)
