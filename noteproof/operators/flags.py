"""Risk flags of releases: what the claims, the coverage of files, the dependencies and the version number give away."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import manifests

# Shares and bars of the flag rules.
WELL_DOCUMENTED = 0.6
OUT_OF_REPO_BASELINE, OUT_OF_REPO_LEAST = 0.25, 3
CONVENTIONAL_SHARE = 0.25
CONVENTIONAL = r"^(feat|fix|chore|docs|refactor|perf|test|build|ci|style|revert)(\([^)]*\))?!?:\s"
FEATURE = r"^feat(\([^)]*\))?!?:\s"
SECURITY_SECTION = r"(?i)securit|vulnerab|cve"

SCHEMA = ["release", "severity", "kind", "subject", "n"]


def _flag(rows: DataFrame, severity, kind: str, subject, n) -> DataFrame:
    return rows.select("release", severity.alias("severity"), F.lit(kind).alias("kind"), subject.cast("string").alias("subject"), n.cast("long").alias("n"))


def bump_flags(releases: DataFrame, commits: DataFrame) -> DataFrame:
    """Flags of releases whose version number promises less change than their commits declare.

    releases: release, base_ref, head_ref; commits: release, subject, body. Merges are left out. A patch, or a minor from
    1.0.0 on, with breaking commits warns; a patch with features informs where a quarter of the
    subjects are conventional. Tags of another form, prereleases and major bumps are out of scope."""
    base, head = T.semver(F.col("base_ref")), T.semver(F.col("head_ref"))
    claimed = releases.select("release", base.alias("base"), head.alias("head")).where("base is not null and head is not null and base.prerelease is null and head.prerelease is null")
    claimed = claimed.select("release", F.col("base.major").alias("major"), T.bump_kind(F.col("base"), F.col("head")).alias("bump")).where("bump in ('minor', 'patch')")
    own = commits.where(~F.col("subject").startswith("Merge "))
    breaking, subject = T.is_breaking(F.col("subject"), F.col("body")), F.col("subject")
    told = own.groupBy("release").agg(
        F.count_if(breaking).alias("breaking"), F.count_if(subject.rlike(CONVENTIONAL)).alias("conventional"),
        F.count_if(subject.rlike(FEATURE) & ~breaking).alias("features"), F.count(F.lit(1)).alias("own"),
    )
    met = claimed.join(told, "release")
    broken = met.where((F.col("breaking") > 0) & ((F.col("bump") == "patch") | (F.col("major") >= 1)))
    featured = met.where((F.col("bump") == "patch") & (F.col("features") > 0) & (F.col("conventional") >= CONVENTIONAL_SHARE * F.col("own")))
    return _flag(broken, F.lit("warn"), "bump-mismatch", F.col("bump"), F.col("breaking")).unionByName(
        _flag(featured, F.lit("info"), "bump-mismatch-feat", F.col("bump"), F.col("features"))
    )


def claim_flags(claims: DataFrame) -> DataFrame:
    """Flags of contradicted, unjudged and unsupported claims, one per release and kind.

    claims: release, kind, verdict, judge_failed."""
    told = claims.groupBy("release").agg(
        F.count_if(F.col("verdict") == "contradicted").alias("contradicted"),
        F.count_if("judge_failed").alias("unjudged"),
        F.count_if((F.col("verdict") == "no-evidence") & (F.col("kind") == "change")).alias("unsupported"),
    )
    parts = [
        _flag(told.where(F.col(c) > 0), F.lit(severity), kind, F.lit(None), F.col(c))
        for c, severity, kind in (("contradicted", "critical", "contradicted-claim"), ("unjudged", "warn", "judge-unavailable"), ("unsupported", "warn", "unsupported-claim"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def surplus_flags(surplus: DataFrame) -> DataFrame:
    """Flags of vague claims that hide notable changes; critical where one touches sensitive code.

    surplus: release, claim, file, notable."""
    told = surplus.where("notable").groupBy("release", "claim").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(T.sensitive_category(F.col("file")) == "auth/crypto", F.lit(False))).alias("auth")
    )
    return _flag(told, F.when(F.col("auth"), "critical").otherwise("warn"), "vague-claim-surplus", F.col("claim"), F.col("n"))


def file_flags(files: DataFrame, ratios: DataFrame | None = None) -> DataFrame:
    """Flags of undocumented sensitive files (one per category), new dependencies, lockfile sources and opaque changes (one per file).

    files: release, path, status, additions, deletions, patch, coverage (evidence, covered,
    undocumented or unknown) and optionally repo; ratios: release, ratio (documented share of the
    churn, null if unknown). A silent change of sensitive code is critical only where the notes are otherwise complete."""
    kinds = files.where("coverage = 'undocumented'").select("release", T.sensitive_category(F.col("path")).alias("category")).where("category is not null")
    told = kinds.groupBy("release", "category").agg(F.count(F.lit(1)).alias("n"))
    if ratios is not None:
        told = told.join(ratios.select("release", "ratio"), "release", "left")
    else:
        told = told.withColumn("ratio", F.lit(None).cast("double"))
    silent = (F.col("category") == "auth/crypto") & (F.col("ratio").isNull() | (F.col("ratio") >= WELL_DOCUMENTED))
    out = _flag(told, F.when(silent, "critical").otherwise("warn"), "undocumented-sensitive", F.col("category"), F.col("n"))
    hidden = F.col("coverage") == "undocumented"
    added = manifests.new_dependencies(files).groupBy("release", "path").agg(F.count(F.lit(1)).alias("n")).join(files.select("release", "path", "coverage"), ["release", "path"])
    out = out.unionByName(_flag(added, F.when(hidden, "critical").otherwise("info"), "new-dependency", F.col("path"), F.col("n")))
    sources = files.withColumn("n", F.size(manifests.lockfile_sources(F.col("path"), F.col("patch")))).where("n > 0")
    out = out.unionByName(_flag(sources, F.when(hidden, "critical").otherwise("warn"), "lockfile-source", F.col("path"), F.col("n")))
    issue = manifests.opacity_issue(*[F.col(c) for c in ("path", "status", "patch", "additions", "deletions")])
    opaque = files.withColumn("issue", issue).where("issue is not null")
    noted = F.col("coverage").isin("evidence", "covered")
    return out.unionByName(_flag(opaque, F.when(noted, "warn").otherwise("critical"), "opaque-change", F.col("path"), F.lit(1)))


def unverifiable(files: DataFrame, claims: DataFrame, flags: DataFrame, baselines: DataFrame | None = None) -> DataFrame:
    """release, shape: sourceless or out-of-repo, for releases whose claims could not be checked against their own diff.

    files: release, path; claims: release, kind, verdict, advisories, section; baselines: release,
    snapshots, lexical_coverage (of the releases before). A contradicted claim or a critical flag rules it out."""
    bad = claims.where("verdict = 'contradicted'").select("release").unionByName(flags.where("severity = 'critical'").select("release")).distinct()
    releases = files.select("release").unionByName(claims.select("release")).distinct().join(bad, "release", "left_anti")
    sources = files.where(T.is_source_file(F.col("path"))).select("release").distinct().withColumn("source", F.lit(True))
    secure = (F.size("advisories") > 0) | F.col("section").rlike(SECURITY_SECTION)
    change = claims.where("kind = 'change' and verdict <> 'skipped'").groupBy("release").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "no-evidence").alias("missing"), F.bool_or((F.col("verdict") == "no-evidence") & secure).alias("secure")
    )
    rows = releases.join(sources, "release", "left").join(change, "release", "left")
    shape = F.when(F.col("source").isNull(), "sourceless")
    if baselines is not None:
        rows = rows.join(baselines.select("release", "snapshots", "lexical_coverage"), "release", "left")
        usual = (F.col("snapshots") >= OUT_OF_REPO_LEAST) & (F.col("lexical_coverage") <= OUT_OF_REPO_BASELINE)
        shape = shape.when((3 * F.col("missing") > 2 * F.col("n")) & ~F.col("secure") & usual, "out-of-repo")
    return rows.select("release", shape.alias("shape")).where("shape is not null")


def demoted(flags: DataFrame, shapes: DataFrame) -> DataFrame:
    """Unsupported claims of unverifiable releases inform only, as not verifiable; other flags stay."""
    rows = flags.join(shapes.select("release", F.lit(True).alias("excused")), "release", "left")
    hit = F.coalesce("excused", F.lit(False)) & (F.col("kind") == "unsupported-claim")
    return rows.withColumn("severity", F.when(hit, "info").otherwise(F.col("severity"))).withColumn("kind", F.when(hit, "not-verifiable").otherwise(F.col("kind"))).select(*SCHEMA)
