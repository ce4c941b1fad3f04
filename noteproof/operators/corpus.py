"""A corpus of stored checks: what classes of claims cost a judge, snapshots of past releases and the baseline they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import coverage, manifests
from .pin_moves import bump_claim
from .scoring import score_label

# Methods of evidence that anchor a claim; tokens, prices and pace of the cost model.
ANCHORS = ("pr-anchor", "sha-anchor", "pin-anchor")
CHARS_PER_TOKEN, RESERVE_SHARE, CALL_SECONDS, CALL_OUTPUT_TOKENS = 4, 0.5, 10, 300
INPUT_PRICE, OUTPUT_PRICE = 1.0, 5.0


def claim_class() -> Column:
    """One of seven: meta, bump, generated, and by anchors and lexical evidence. Columns kind, text, generated, methods."""
    anchored, lexical = F.exists("methods", lambda m: m.isin(*ANCHORS)), F.array_contains("methods", "lexical")
    return (
        F.when(F.col("kind") == "meta", "meta").when(bump_claim(F.col("text")).isNotNull(), "bump").when(F.coalesce("generated", F.lit(False)), "generated")
        .when(anchored, F.when(lexical, "anchored-strong").otherwise("anchored-weak")).when(lexical, "unanchored-lexical").otherwise("unanchored-none")
    )


def judge_calls() -> Column:
    """Calls that a claim cost at least: none unless a judge was asked; its votes, or two if escalated, or one; one more for a surplus found."""
    asked = F.coalesce("judged", F.lit(False)) | F.coalesce("judge_failed", F.lit(False))
    votes = F.coalesce(F.size("votes"), F.lit(0))
    own = F.when(votes > 0, votes).when(F.array_contains("methods", "escalated"), 2).otherwise(1)
    return F.when(asked, own + F.coalesce("surplus", F.lit(False)).cast("int")).otherwise(0)


def judge_bill(results: DataFrame, *keys: str) -> DataFrame:
    """keys, class, claims, judged, failed, calls, second_look, split: per class of claims.

    results: kind, text, generated, methods, judged, judge_failed, votes, surplus (whether one was found); nulls count as absent."""
    whole = results.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("methods", "votes")})
    rows = whole.select(*keys, claim_class().alias("class"), judge_calls().alias("calls"), "judged", "judge_failed", "votes")
    return rows.groupBy(*keys, "class").agg(
        F.count(F.lit(1)).alias("claims"), F.count_if("judged").alias("judged"), F.count_if("judge_failed").alias("failed"), F.sum("calls").cast("long").alias("calls"),
        F.count_if(F.size("votes") > 0).alias("second_look"), F.count_if(F.size(F.array_distinct("votes")) > 1).alias("split"),
    )


def cost_estimate(requests: DataFrame, concurrency: int = 4) -> DataFrame:
    """release, calls, input_tokens, reserve, minutes, dollars of a judge run; requests: release, chars, calls."""
    summed = requests.groupBy("release").agg(F.sum("chars").alias("chars"), F.sum("calls").alias("calls"))
    tokens, reserve = F.round(F.col("chars") / CHARS_PER_TOKEN).cast("long"), F.ceil(F.col("calls") * RESERVE_SHARE).cast("long")
    minutes = (F.col("calls") + reserve / 2) * CALL_SECONDS / concurrency / 60
    dollars = tokens / 1e6 * INPUT_PRICE + F.col("calls") * CALL_OUTPUT_TOKENS / 1e6 * OUTPUT_PRICE
    return summed.select("release", "calls", tokens.alias("input_tokens"), reserve.alias("reserve"), minutes.alias("minutes"), dollars.alias("dollars"))


def author_key(email: Column, name: Column) -> Column:
    """Identity of a commit's author: the lower-cased address, else the name."""
    mail = F.lower(F.trim(email))
    return F.coalesce(F.nullif(mail, F.lit("")), name)


def snapshots(releases: DataFrame, claims: DataFrame, commits: DataFrame, files: DataFrame) -> DataFrame:
    """One row per past release: release, commits, files, additions, deletions, claims, anchored_coverage,
    lexical_coverage, sensitive, binaries, new_deps, authors, email_accounts.

    releases: release; claims: release, claim, kind, text, code_spans, pr_numbers, shas; commits: release,
    sha, subject, pr_numbers, email, name, login; files: release, path, status, additions, deletions, patch.
    Coverages of a release without commits or change claims are 1. An account is known where a login is."""
    anchors = claims.select("release", F.explode("pr_numbers").alias("n")).distinct().join(commits.select("release", "sha", F.explode("pr_numbers").alias("n")), ["release", "n"]).select("release", "sha")
    cited = claims.select("release", F.explode("shas").alias("cited")).distinct().withColumn("head", F.substring("cited", 1, 7))
    named = cited.join(commits.select("release", "sha", F.substring("sha", 1, 7).alias("head")), ["release", "head"]).where(F.col("sha").startswith(F.col("cited")))
    covered = anchors.unionByName(named.select("release", "sha")).distinct().groupBy("release").agg(F.count(F.lit(1)).alias("covered"))
    mail = F.lower(F.trim("email"))
    pair = F.when((mail != "") & F.col("login").isNotNull(), F.struct(mail.alias("key"), F.col("login").alias("value")))
    told = commits.groupBy("release").agg(
        F.count(F.lit(1)).alias("commits"), F.array_sort(F.collect_set(author_key(F.col("email"), F.col("name")))).alias("authors"),
        F.array_sort(F.collect_set(pair)).alias("email_accounts"),
    )
    issue = manifests.opacity_issue(*[F.col(c) for c in ("path", "status", "patch", "additions", "deletions")])
    changed = files.groupBy("release").agg(
        F.count(F.lit(1)).alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"),
        F.array_sort(F.collect_set(T.sensitive_category(F.col("path")))).alias("sensitive"), F.count_if(issue == "binary file").alias("binaries"),
    )
    deps = manifests.new_dependencies(files).groupBy("release").agg(F.array_sort(F.collect_set("name")).alias("new_deps"))
    change = claims.where("kind = 'change'")
    # a release's diff taken as one commit
    hit = coverage.commit_matches(change.select("release", "claim", "text", "code_spans"), files.select("release", F.lit("").alias("sha"), "path", "patch"))
    hits = hit.where("score > 0").groupBy("release").agg(F.countDistinct("claim").alias("hits"))
    counted = claims.groupBy("release").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("kind") == "change").alias("change"))
    rows = releases.select("release").distinct()
    for part in (told, changed, deps, covered, hits, counted):
        rows = rows.join(part, "release", "left")
    rows = rows.na.fill(0, ["commits", "files", "additions", "deletions", "binaries", "covered", "hits", "claims", "change"])
    return rows.select(
        "release", "commits", "files", "additions", "deletions", "claims",
        F.when(F.col("commits") > 0, F.col("covered") / F.col("commits")).otherwise(1.0).alias("anchored_coverage"),
        F.when(F.col("change") > 0, F.col("hits") / F.col("change")).otherwise(1.0).alias("lexical_coverage"),
        "sensitive", "binaries", F.coalesce("new_deps", F.array().cast("array<string>")).alias("new_deps"), "authors", "email_accounts",
    )


def baseline(past: DataFrame, by: str, order: str) -> DataFrame:
    """by, snapshots, median_churn, lexical_coverage, known_authors, email_accounts (newest wins), ever_binary.

    past: snapshots with ``by`` (the repository) and ``order`` (newer is larger)."""
    whole = past.groupBy(by).agg(
        F.count(F.lit(1)).alias("snapshots"), F.median(F.col("additions") + F.col("deletions")).alias("median_churn"), F.median("lexical_coverage").alias("lexical_coverage"),
        F.bool_or(F.col("binaries") > 0).alias("ever_binary"),
    )
    authors = past.select(by, F.explode("authors").alias("a")).groupBy(by).agg(F.array_sort(F.collect_set("a")).alias("known_authors"))
    pairs = past.select(by, order, F.explode("email_accounts").alias("x")).groupBy(by, "x.key").agg(F.max_by("x.value", order).alias("login"))
    accounts = pairs.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("key", F.col("login").alias("value")))).alias("email_accounts"))
    return whole.join(authors, by, "left").join(accounts, by, "left")


def latest_labels(checks: DataFrame, *order: str) -> DataFrame:
    """label, entries: the score labels of every entry's latest check."""
    newest = Window.partitionBy("entry").orderBy(*[F.desc(c) for c in order])
    latest = checks.withColumn("k", F.row_number().over(newest)).where("k = 1")
    return latest.groupBy(score_label(F.col("score")).alias("label")).agg(F.count(F.lit(1)).alias("entries"))


def trends(checks: DataFrame, *order: str, rows: int = 6) -> DataFrame:
    """entry, scores: the last ``rows`` scores in order, and where each lies between the least and the most of them (0 to 1)."""
    ranked = checks.withColumn("age", F.row_number().over(Window.partitionBy("entry").orderBy(*[F.desc(c) for c in order]))).where(F.col("age") <= rows)
    series = ranked.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct((-F.col("age")).alias("at"), "score"))).alias("s"))
    scores, low, high = F.col("s.score"), F.array_min("s.score"), F.array_max("s.score")
    span = F.when(high > low, high - low).otherwise(1)
    return series.select("entry", scores.alias("scores"), F.transform(scores, lambda x: F.round((x - low) / span, 6)).alias("places"))
