"""Releases from notes and diffs to verdicts: claims parsed, anchored, held against pins and code, and settled by the ladder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.notes import claims_of
from ..stored import stored
from . import ladder, pin_moves, pins

#: Words that a line repeated from the base's notes must have to count as carried over.
CARRIED_WORDS = 4


def parsed_claims(notes: DataFrame, base_notes: DataFrame | None = None) -> DataFrame:
    """The claims of notes (release, notes), with ``claim`` (place in the notes) and carried_over: the text stands in the base's notes, too.

    base_notes: release, notes - of the release that a release is compared with."""
    return marked_carried(claims_of(notes).withColumnRenamed("id", "claim"), base_notes)


def marked_carried(claims: DataFrame, base_notes: DataFrame | None) -> DataFrame:
    """Parsed claims with carried_over: the text stands in the notes of the release's base."""
    if base_notes is None:
        return claims.withColumn("carried_over", F.lit(False))
    claims = claims.withColumn("_key", T.normalized(F.col("text")))
    known = claims_of(base_notes).select("release", T.normalized(F.col("text")).alias("_key"), F.lit(True).alias("carried_over"))
    known = known.where(F.size(F.split("_key", " ")) >= CARRIED_WORDS).distinct()
    return claims.join(known, ["release", "_key"], "left").drop("_key").na.fill(False, ["carried_over"])


def settled_bumps(claims: DataFrame, anchors: DataFrame, commit_files: DataFrame, release_files: DataFrame) -> DataFrame:
    """release, claim, bump, from_check, pin_from, pin_to, via_commit: the pins that claims name, as the release's diff moves them, or else a commit that the claim is anchored to."""
    said = claims.where("kind <> 'meta' and bump is not null").select("release", "claim", "bump.name", "bump.from", "bump.to")
    # the pins of the release's diff and, one by one, of the commits that claims of bumps cite; no commit is named by an empty sha
    own = commit_files.join(anchors.join(said.select("release", "claim"), ["release", "claim"], "left_semi").select("release", "sha").distinct(), ["release", "sha"])
    columns = [F.col("path"), F.col("patch")]
    diffs = release_files.select(F.struct("release", F.lit("").alias("sha")).alias("release"), *columns).unionByName(own.select(F.struct("release", "sha").alias("release"), *columns))
    # only releases with such claims and files that can name pins; stored, as each kind of file is read by itself
    diffs = stored(diffs.where(pin_moves.may_pin(F.col("path"))).join(said.select(F.col("release").alias("_r")).distinct(), F.col("release.release") == F.col("_r"), "left_semi"), "pin-files")
    moves = stored(pin_moves.pin_moves(diffs).select("release.release", "release.sha", "name", "from", "to"), "pins")
    moved = moves.where("sha = ''").drop("sha")
    cited = anchors.join(moves, ["release", "sha"]).select("release", "claim", "name", "from", "to").distinct()
    found = pins.bump_verdicts(said, moved, cited, by=["release"])
    return stored(found.withColumnRenamed("verdict", "bump"), "bumps")


def verify_release(notes: DataFrame, commits: DataFrame, commit_files: DataFrame, release_files: DataFrame, merges: DataFrame | None = None, base_notes: DataFrame | None = None) -> DataFrame:
    """One row per claim: release, claim, section, text, kind, carried_over, anchors (how many commits), bump, from_check, via_commit, verdict, confidence, rung.

    notes and base_notes: release, notes; commits: release, sha, subject, pr_numbers; commit_files: release, sha, path, status,
    patch; release_files: release, path, status, patch; merges: release, number, merged."""
    return verify_claims(stored(parsed_claims(notes, base_notes).drop("promise"), "claims"), commits, commit_files, release_files, merges)


def verify_claims(parsed: DataFrame, commits: DataFrame, commit_files: DataFrame, release_files: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """The rows of ``verify_release`` for claims that are parsed already; they are read several times."""
    key = ["release", "claim"]
    anchors = stored(ladder.all_anchors(parsed, commits, merges), "anchors")
    bumps = settled_bumps(parsed, anchors, commit_files, release_files).select(*key, "bump", "from_check", "via_commit")
    claims = parsed.drop("bump").join(bumps, key, "left")
    verdicts = ladder.verify(claims, commits, commit_files, release_files, anchors=anchors)
    counted = anchors.groupBy(*key).agg(F.count(F.lit(1)).alias("anchors"))
    rows = claims.join(verdicts, key).join(counted, key, "left").na.fill(0, ["anchors"])
    return rows.select(*key, "section", "text", "kind", "carried_over", "anchors", "bump", "from_check", "via_commit", "verdict", "confidence", "rung")
