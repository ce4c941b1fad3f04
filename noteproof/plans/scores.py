"""Queries on scores, verdicts and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapt
from ..functions import text as T
from ..operators import scoring
from ..registry import query
from .sql import SHAPES, SHAPES_SQL, category_sql



def _verdict():
    return F.when(F.col("verdict_code") == "N", "verified").when(F.col("verdict_code") == "R", "partial").otherwise("no-evidence")


_FILES_SQL = """
files AS (
  SELECT l_orderkey AS sha, replace(p_type, ' ', '/') || '/' || replace(p_name, ' ', '_') AS path,
         CAST(l_quantity AS BIGINT) AS additions, CAST(l_linenumber AS BIGINT) AS deletions, l_linestatus AS status,
         l_linenumber AS ord, l_returnflag AS verdict_code, l_discount AS discount, l_suppkey AS supplier, l_partkey AS part, l_tax AS tax
  FROM lineitem JOIN part ON l_partkey = p_partkey)
"""
_COMMITS_SQL = """
commits AS (
  SELECT o_orderkey AS sha, o_custkey AS author, c_nationkey AS repo, o_orderdate AS committed_at, o_orderpriority AS subject,
         o_orderstatus AS status, o_totalprice AS worth
  FROM orders JOIN customer ON o_custkey = c_custkey)
"""
_TRUST_SQL = f"""
WITH {_FILES_SQL}, {_COMMITS_SQL},
f AS (SELECT repo, files.* FROM files JOIN commits USING (sha)),
c AS (SELECT repo,
        sum((CASE WHEN ord > 4 THEN 0.25 ELSE 1.0 END)::DOUBLE * (CASE verdict_code WHEN 'N' THEN 1.0 WHEN 'R' THEN 0.5 ELSE 0.0 END)::DOUBLE) AS points,
        sum((CASE WHEN ord > 4 THEN 0.25 ELSE 1.0 END)::DOUBLE) AS weight,
        sum(additions + deletions) AS churn, sum(CASE WHEN discount > 0.02 THEN additions + deletions ELSE 0 END) AS covered,
        bool_and(NOT (repo % 5 = 4 AND tax > 0.07)) AS readable
      FROM f GROUP BY repo),
g AS (SELECT repo, count(*) FILTER (worth > 450000) AS critical, count(*) FILTER (worth > 440000 AND worth <= 450000) AS warn FROM commits GROUP BY repo),
p AS (SELECT repo, coalesce(critical, 0) AS critical,
        CASE WHEN weight > 0 THEN round(100 * points / weight) ELSE 100.0 END AS correctness,
        CASE WHEN readable THEN CASE WHEN churn > 0 THEN round(100 * covered::DOUBLE / churn) ELSE 100.0 END END AS completeness,
        greatest(0.0, 100.0 - 25 * coalesce(critical, 0) - 10 * coalesce(warn, 0))::DOUBLE AS risk
      FROM c LEFT JOIN g USING (repo)),
b AS (SELECT *, CASE WHEN completeness IS NULL THEN round(0.6::DOUBLE * correctness + 0.4::DOUBLE * risk)
        ELSE round(0.45::DOUBLE * correctness + 0.25::DOUBLE * completeness + 0.3::DOUBLE * risk) END AS blend FROM p),
o AS (SELECT *, CASE WHEN critical > 0 THEN least(blend, 45) ELSE blend END AS overall FROM b)
SELECT repo, correctness::BIGINT AS correctness, completeness::BIGINT AS completeness, risk::BIGINT AS risk, overall::BIGINT AS overall,
       CASE WHEN overall >= 85 THEN 'solid' WHEN overall >= 65 THEN 'minor gaps' WHEN overall >= 45 THEN 'questionable' ELSE 'suspicious' END AS label
FROM o
"""


def _trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = adapt.commits(spark, sf_dir)
    files = adapt.changed_files(spark, sf_dir).join(commits.select("sha", "repo"), "sha")
    claims = files.select("repo", _verdict().alias("verdict"), (F.col("ord") > 4).alias("generated"))
    measured = files.select(
        "repo",
        (F.col("additions") + F.col("deletions")).alias("churn"),
        (F.col("discount") > 0.02).alias("covered"),
        (~((F.col("repo") % 5 == 4) & (F.col("tax") > 0.07))).alias("readable"),
    )
    severity = F.when(F.col("worth") > 450000, "critical").when(F.col("worth") > 440000, "warn")
    flags = commits.select("repo", severity.alias("severity")).where("severity is not null")
    return scoring.trust_scores(claims, measured, flags, "repo")


@query(_TRUST_SQL)
def trust_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trust(spark, sf_dir)


@query(f"""
WITH t AS ({_TRUST_SQL}), s AS (
  SELECT repo, unnest([0, 1, 2, 3]) AS step, unnest(['start', 'correctness', 'completeness', 'risk']) AS label,
         unnest([100.0::DOUBLE, -round(0.45::DOUBLE * (100 - correctness), 2), -round(0.25::DOUBLE * (100 - coalesce(completeness, 100)), 2), -round(0.3::DOUBLE * (100 - risk), 2)]) AS delta
  FROM t)
SELECT repo, step::INT AS step, label, delta, round(sum(delta) OVER (PARTITION BY repo ORDER BY step), 2) AS total FROM s
""")
def score_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.waterfall(_trust(spark, sf_dir), "repo")


@query("""
SELECT lang, count(*) FILTER (v = 'verified') AS verified, count(*) FILTER (v = 'partial') AS partial,
       count(*) FILTER (v = 'no-evidence') AS no_evidence, count(*) FILTER (v = 'contradicted') AS contradicted
FROM (SELECT lang, CASE WHEN quality = 1 AND toxic = 0 THEN 'verified' WHEN quality = 1 THEN 'partial' WHEN toxic = 0 THEN 'no-evidence' ELSE 'contradicted' END AS v
      FROM labels JOIN documents USING (doc_id)) GROUP BY lang
""")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapt.table(spark, sf_dir, "labels").join(adapt.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    verdict = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "verified").when(F.col("quality") == 1, "partial").when(F.col("toxic") == 0, "no-evidence").otherwise("contradicted")
    )
    return scoring.verdict_counts(rows.withColumn("verdict", verdict), "lang")


@query(f"""
WITH {_FILES_SQL}, {_COMMITS_SQL}
SELECT repo, strftime(committed_at, '%Y-%m') AS month, count(DISTINCT sha) AS commits, count(DISTINCT author) AS authors, count(*) AS files,
       sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions
FROM files JOIN commits USING (sha) GROUP BY ALL
""")
def release_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = adapt.changed_files(spark, sf_dir).join(adapt.commits(spark, sf_dir).select("sha", "author", "repo", "committed_at"), "sha")
    return joined.groupBy("repo", F.date_format("committed_at", "yyyy-MM").alias("month")).agg(
        F.countDistinct("sha").alias("commits"), F.countDistinct("author").alias("authors"), F.count(F.lit(1)).alias("files"),
        F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"),
    )


@query(f"""
SELECT category, count(*) AS files, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS share
FROM (SELECT additions, deletions, {category_sql("path")} AS category FROM (SELECT l_quantity::BIGINT AS additions, l_linenumber::BIGINT AS deletions, ({SHAPES_SQL})[1 + l_partkey % {len(SHAPES)}] AS path FROM lineitem)) GROUP BY category
""")
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, additions and deletions of each kind of file."""
    path = F.get(F.array(*[F.lit(x) for x in SHAPES]), (F.col("part") % len(SHAPES)).cast("int"))
    rows = adapt.changed_files(spark, sf_dir).select("additions", "deletions", T.file_category(path).alias("category"))
    grouped = rows.groupBy("category").agg(F.count(F.lit(1)).alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    total = grouped.agg(F.sum("files").alias("t")).scalar()
    return grouped.withColumn("share", F.round(100.0 * F.col("files") / total, 2))


@query("""
WITH v AS (SELECT conv_id, CASE WHEN length(text) % 4 = 0 THEN 0 WHEN length(text) % 4 = 1 THEN 1 WHEN length(text) % 4 = 2 THEN 2 ELSE 3 END AS s FROM conversations),
g AS (SELECT conv_id, list_sort(list(s)) AS v, count(*) AS n, count(*) FILTER (s = 3) AS c, max(s) FILTER (s < 3) AS other FROM v GROUP BY conv_id),
m AS (SELECT *, v[CAST(ceil((n - 1) / 2.0) AS INT) + 1] AS med FROM g)
SELECT conv_id, n AS votes, (['verified', 'partial', 'no-evidence', 'contradicted'])[med + 1] AS median,
       (['verified', 'partial', 'no-evidence', 'contradicted'])[(CASE WHEN med = 3 AND c < 2 AND other IS NOT NULL THEN other ELSE med END) + 1] AS resolved FROM m
""")
def vote_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in scoring.VERDICTS])
    votes = adapt.table(spark, sf_dir, "conversations").select("conv_id", F.get(names, F.length("text") % 4).alias("verdict"))
    return scoring.resolve_votes(votes, "conv_id")


@query("SELECT user_id AS entry, (list_sort(list(least(100, floor(value))::BIGINT)))[(count(*) // 2) + 1] AS upper_median FROM events GROUP BY user_id")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.upper_median(adapt.checks(spark, sf_dir), "entry", "score")


@query("""
SELECT lang, kind, sum(n)::BIGINT AS claims, sum(CASE WHEN doubtful THEN n ELSE 0 END)::BIGINT AS doubtful,
       CASE WHEN bool_or(kind = 'rejected' AND doubtful) THEN 'reject' WHEN bool_or(doubtful) THEN 'soft' ELSE 'clean' END AS gate
FROM (SELECT lang, CASE WHEN quality = 1 THEN 'accepted' ELSE 'rejected' END AS kind, toxic = 1 AS doubtful, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL)
GROUP BY lang, kind
""")
def gate_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapt.table(spark, sf_dir, "labels").join(adapt.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    kind = F.when(F.col("quality") == 1, "accepted").otherwise("rejected")
    doubtful = F.col("toxic") == 1
    return rows.groupBy("lang", kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("claims"),
        F.count_if(doubtful).alias("doubtful"),
        F.when(F.bool_or((kind == "rejected") & doubtful), "reject").when(F.bool_or(doubtful), "soft").otherwise("clean").alias("gate"),
    )


@query("""
SELECT check_kind, label, tally, round(100.0::DOUBLE * tally / total, 2) AS share FROM (
  SELECT CASE WHEN hour(ts) < 12 THEN 'early' ELSE 'late' END AS check_kind, event_type AS label, count(*) AS tally, (SELECT count(*) FROM events) AS total
  FROM events GROUP BY ROLLUP (1, 2))
""")
def origin_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapt.checks(spark, sf_dir).select(F.when(F.hour("published_at") < 12, "early").otherwise("late").alias("check_kind"), "label")
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    tallied = rows.rollup("check_kind", "label").agg(F.count(F.lit(1)).alias("tally"))
    return tallied.withColumn("share", F.round(100.0 * F.col("tally") / total, 2))


@query("""
SELECT kind, count(*) AS claims, sum(calls)::BIGINT AS calls, count(*) FILTER (calls > 1) AS split, round(count(*)::DOUBLE / (SELECT count(*) FROM labels), 6) AS share
FROM (SELECT CASE WHEN n_chars < 400 THEN 'short' WHEN toxic = 1 THEN 'disputed' WHEN quality = 1 THEN 'settled' ELSE 'open' END AS kind, 1 + toxic + (1 - quality) AS calls
      FROM labels JOIN documents USING (doc_id)) GROUP BY kind
""")
def claim_classes_bill(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = adapt.table(spark, sf_dir, "labels")
    rows = labels.join(adapt.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    kind = F.when(F.col("n_chars") < 400, "short").when(F.col("toxic") == 1, "disputed").when(F.col("quality") == 1, "settled").otherwise("open")
    calls = 1 + F.col("toxic") + (1 - F.col("quality"))
    total = labels.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("claims"), F.sum(calls).alias("calls"), F.count_if(calls > 1).alias("split")).withColumn(
        "share", F.round(F.col("claims") / total, 6)
    )


@query("""
SELECT DISTINCT a.p_size AS p_size, a.p_retailprice AS p_retailprice FROM part a
WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))
""")
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest size for least price: on two axes one running minimum replaces the self anti join.

    Sizes are reduced to their best price first; a size is on the front if no larger one is as cheap."""
    from pyspark.sql import Window

    best = adapt.table(spark, sf_dir, "part").groupBy("p_size").agg(F.min("p_retailprice").alias("p_retailprice"))
    larger = F.min("p_retailprice").over(Window.orderBy(F.desc("p_size")).rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("m", larger).where("m is null or p_retailprice < m").select("p_size", "p_retailprice")


