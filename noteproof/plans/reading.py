"""Queries on what is read of a release, on fronts, histories, stored reports and cached answers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapt
from ..functions import text as T
from ..operators import cache, findings, lineage, skyline
from ..registry import query
from ..stored import folder
from .sql import SHAPES, SHAPES_SQL, category_sql, sensitive_sql

BUDGET = 70_000
_WEIGHTS_SQL = "CASE " + " ".join(f"WHEN category = '{k}' THEN {w}" for k, w in findings.WEIGHTS.items()) + " END"
_GROUPING = "'src','packages','crates','apps','lib','libs','internal','pkg','cmd','modules','services'"


@query(f"""
WITH f AS (SELECT l_suppkey AS release, CASE WHEN l_orderkey % 3 = 0 THEN 'src/m' || l_partkey % 7 || '/' ELSE '' END || ({SHAPES_SQL})[1 + l_partkey % {len(SHAPES)}] AS path, l_quantity::BIGINT AS additions, l_linenumber::BIGINT AS deletions FROM lineitem WHERE l_discount <> 0.05),
s AS (SELECT release, {category_sql("path")} AS category, {sensitive_sql("path")} AS sensitive, string_split(path, '/') AS p, additions + deletions AS churn, path FROM f),
g AS (SELECT release, CASE WHEN len(p) = 1 THEN '(root)' WHEN len(p) > 2 AND p[1] IN ({_GROUPING}) THEN p[1] || '/' || p[2] ELSE p[1] END AS subsystem,
  {_WEIGHTS_SQL} * log2(2 + churn) + CASE WHEN sensitive IS NOT NULL THEN 4 ELSE 0 END AS score FROM s WHERE NOT regexp_matches(path, '{T.CHANGELOG}')),
r AS (SELECT release, subsystem, count(*) AS files, round(sum(score), 6) AS score FROM g GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY release ORDER BY score DESC, subsystem) AS place FROM r)
SELECT release, subsystem, files, place, (CASE WHEN {BUDGET} - 20000 * (place - 1) >= 4000 THEN least(20000, {BUDGET} - 20000 * (place - 1)) ELSE 0 END)::BIGINT AS alloc FROM k
""")
def findings_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subsystems of every supplier's changed files in reading order, with what each may spend."""
    line = adapt.table(spark, sf_dir, "lineitem")
    shape = F.get(F.array(*[F.lit(s) for s in SHAPES]), (F.col("l_partkey") % len(SHAPES)).cast("int"))
    head = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("src/m"), (F.col("l_partkey") % 7).cast("string"), F.lit("/"))).otherwise("")
    files = line.select(
        F.col("l_suppkey").alias("release"), F.concat(head, shape).alias("path"), F.col("l_quantity").cast("long").alias("additions"), F.col("l_linenumber").cast("long").alias("deletions"),
        F.when(F.col("l_discount") != 0.05, F.lit("@@")).alias("patch"),
    )
    return findings.plan_findings(files, BUDGET).drop("score")


@query("""
WITH l AS (SELECT doc_id, pos, line, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL)),
s AS (SELECT doc_id, pos, CASE WHEN length(line) > 1000 - used THEN substr(line, 1, (1000 - used)::BIGINT) || '… [truncated]' ELSE line END AS shown FROM l WHERE used < 1000)
SELECT doc_id, count(*) AS lines, sum(length(shown))::BIGINT AS shown, sha256(string_agg(shown, chr(10) ORDER BY pos)) AS shown_sha256 FROM s GROUP BY doc_id
""")
def evidence_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document until a thousand characters are spent, the last one cut and marked; no row moves."""
    docs = adapt.table(spark, sf_dir, "documents").where("text is not null")
    cut = docs.select("doc_id", findings.cut_texts(F.split("text", "\n"), 1000).alias("lines"))
    joined = F.array_join("lines", "\n")
    size = F.aggregate("lines", F.lit(0), lambda n, x: n + F.length(x))
    return cut.select("doc_id", F.size("lines").cast("long").alias("lines"), size.cast("long").alias("shown"), F.sha2(joined.cast("binary"), 256).alias("shown_sha256"))


_POINTS_SQL = "p AS (SELECT DISTINCT l_quantity AS quantity, 1 - l_discount AS discount, l_tax AS tax, -round(l_extendedprice / 1000) AS price FROM lineitem)"


@query(f"""
WITH {_POINTS_SQL}
SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.quantity >= a.quantity AND b.discount >= a.discount AND b.tax >= a.tax AND b.price >= a.price
  AND (b.quantity > a.quantity OR b.discount > a.discount OR b.tax > a.tax OR b.price > a.price))
""")
def pareto_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The front of line items on four axes: more of it, less discount, more tax, a lower price."""
    line = adapt.table(spark, sf_dir, "lineitem")
    points = line.select(F.col("l_quantity").alias("quantity"), (1 - F.col("l_discount")).alias("discount"), F.col("l_tax").alias("tax"), (-F.round(F.col("l_extendedprice") / 1000)).alias("price"))
    return skyline.pareto(points, ["quantity", "discount", "tax", "price"])


@query("""
WITH RECURSIVE c AS (SELECT o_orderkey AS sha, CASE WHEN o_orderkey % 700 = 0 THEN NULL ELSE o_orderkey - 1 - CASE WHEN o_orderkey % 700 > 3 THEN o_orderkey % 2 ELSE 0 END END AS parent FROM orders),
w AS (SELECT sha, sha AS at, parent AS next, 1 AS n FROM c UNION ALL SELECT w.sha, c.sha, c.parent, n + 1 FROM w JOIN c ON c.sha = w.next WHERE n < 300)
SELECT c.sha, w.at AS root FROM c LEFT JOIN w ON w.sha = c.sha AND w.next IS NULL AND w.n > 1
""")
def root_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root of every commit's history, where it lies within three hundred commits."""
    k = F.col("o_orderkey")
    parent = F.when(k % 700 > 0, k - 1 - F.when(k % 700 > 3, k % 2).otherwise(0))
    return lineage.roots(adapt.table(spark, sf_dir, "orders").select(k.alias("sha"), parent.alias("parent")))


@query("""
WITH d AS (SELECT doc_id AS repo, list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{4,}')))[1:9] AS x FROM documents)
SELECT repo, 'v1.' || k || '.0' AS tag, 'about ' || x[k + 1] AS notes FROM (SELECT repo, x, unnest(range(len(x))) AS k FROM d) WHERE k % 3 > 0
""")
def changelog_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases that a changelog proves: tags newest first, prereleases and tags without a section left out."""
    docs = adapt.table(spark, sf_dir, "documents")
    words = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{4,}"), 0))), 1, 9)
    held = docs.select(F.col("doc_id").alias("repo"), words.alias("words"))
    name = lambda k: F.concat(F.lit("1."), k.cast("string"), F.lit(".0"))
    section = lambda w, k: F.concat(F.when(k % 3 > 0, F.concat(F.lit("## "), name(k))).otherwise("### other"), F.lit("\nabout "), w, F.lit("\n\n"))
    changelogs = held.select("repo", F.concat(F.lit("# Changelog\n\n"), F.array_join(F.transform("words", section), "")).alias("text"))
    tags = held.select("repo", F.posexplode("words").alias("k", "word")).select("repo", "k", F.explode(F.array(F.concat(F.lit("v"), name(F.col("k"))), F.concat(F.lit("v"), name(F.col("k")), F.lit("-rc.1")))).alias("tag"))
    # the sections of other words are level three below the section before, so they are part of it
    found = lineage.provable_releases(changelogs, tags.select("repo", "tag", F.col("k").alias("tagged_at")))
    return found.select("repo", "tag", F.get(F.split("notes", "\n"), F.lit(0)).alias("notes"))


@query("""
WITH a AS (SELECT l_orderkey AS report, list_distinct(list('--f' || l_partkey % 40) FILTER (l_tax < 0.06)) AS added, list_distinct(list('--f' || l_suppkey % 40) FILTER (l_tax >= 0.03)) AS removed FROM lineitem WHERE l_orderkey % 11 > 0 GROUP BY l_orderkey),
b AS (SELECT l_orderkey AS report, list_distinct(list('--f' || l_partkey % 40) FILTER (l_tax < 0.07)) AS added, list_distinct(list('--f' || l_suppkey % 40) FILTER (l_tax >= 0.02)) AS removed FROM lineitem WHERE l_orderkey % 13 > 0 GROUP BY l_orderkey),
m AS (SELECT report, CASE WHEN a.report IS NULL THEN 'rebuilt' WHEN b.report IS NULL THEN 'stored' ELSE 'both' END AS "where", coalesce(a.added, []) AS aa, coalesce(b.added, []) AS ba, coalesce(a.removed, []) AS ar, coalesce(b.removed, []) AS br FROM a FULL JOIN b USING (report)),
d AS (SELECT report, "where", list_sort(list_filter(aa, lambda x: NOT list_contains(ba, x))) AS added_gone, list_sort(list_filter(ba, lambda x: NOT list_contains(aa, x))) AS added_new,
  list_sort(list_filter(ar, lambda x: NOT list_contains(br, x))) AS removed_gone, list_sort(list_filter(br, lambda x: NOT list_contains(ar, x))) AS removed_new FROM m)
SELECT report, "where", len(added_gone) + len(added_new) + len(removed_gone) + len(removed_new) > 0 AS moved, array_to_string(added_gone, ',') AS added_gone, array_to_string(added_new, ',') AS added_new,
  array_to_string(removed_gone, ',') AS removed_gone, array_to_string(removed_new, ',') AS removed_new FROM d
""")
def report_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces of stored reports held against rebuilt ones."""
    line = adapt.table(spark, sf_dir, "lineitem")
    flag = lambda c: F.concat(F.lit("--f"), (F.col(c) % 40).cast("string"))

    def reports(low: float, high: float, skip: int) -> DataFrame:
        kept = line.where(F.col("l_orderkey") % skip > 0)
        return kept.groupBy(F.col("l_orderkey").alias("report")).agg(
            F.collect_set(F.when(F.col("l_tax") < high, flag("l_partkey"))).alias("added"), F.collect_set(F.when(F.col("l_tax") >= low, flag("l_suppkey"))).alias("removed")
        )

    found = lineage.compare_reports(reports(0.03, 0.06, 11), reports(0.02, 0.07, 13), ["report"], ["added", "removed"])
    return found.select("report", "where", "moved", *[F.array_join(c, ",").alias(c) for c in ("added_gone", "added_new", "removed_gone", "removed_new")])


@query("""
WITH k AS (SELECT source, n_chars, text, lang FROM documents), first AS (SELECT DISTINCT lang, n_chars, source, text FROM k WHERE lang = 'en'), every AS (SELECT DISTINCT lang, n_chars, source, text FROM k)
SELECT 1 AS run, (SELECT count(*) FROM k WHERE lang = 'en') AS asked, 0 AS hits, (SELECT count(*) FROM first) AS computed, (SELECT count(*) FROM first) AS kept
UNION ALL SELECT 2, (SELECT count(*) FROM k), (SELECT count(*) FROM k WHERE lang = 'en'), (SELECT count(*) FROM every) - (SELECT count(*) FROM first), (SELECT count(*) FROM every)
""")
def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over a cache, the second of which finds what the first one asked and computes the misses only."""
    path = f"{folder(spark)}/noteproof/answers-{uuid.uuid4().hex}"
    docs = adapt.table(spark, sf_dir, "documents").select(cache.fingerprint("lang", "n_chars", "source", "text").alias("key"), "lang", "text")
    size = lambda misses: misses.select("key", F.length(F.coalesce("text", F.lit(""))).cast("string").alias("value"))
    out = None
    for run, asked in ((1, docs.where("lang = 'en'")), (2, docs)):
        rows, misses = cache.answered(asked, path, "v1", f"run-{run}", size)
        kept = cache.histogram(cache.read(spark, path)).agg(F.sum("answers").alias("kept"))
        told = rows.agg(F.lit(run).alias("run"), F.count(F.lit(1)).alias("asked"), F.count_if("cached").alias("hits"), F.lit(misses.count()).cast("long").alias("computed"))
        told = told.withColumn("kept", F.lit(kept.first()[0]).cast("long"))
        out = told if out is None else out.unionByName(told)
    return out
