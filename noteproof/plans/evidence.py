"""Queries that join claims, commits, files and pins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapt
from ..functions import text as T
from ..operators import matching, pins, surface
from ..registry import query
from .scores import _COMMITS_SQL, _FILES_SQL
from .sql import SHAPES, SHAPES_SQL, TERMS_SQL, sensitive_sql, tokens_sql


@query("""
SELECT 'c' || event_id AS claim, o_orderkey::VARCHAR AS sha FROM events JOIN orders ON o_orderkey = event_id % 20000
""")
def anchor_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = adapt.table(spark, sf_dir, "events")
    claims = events.select(F.concat(F.lit("c"), "event_id").alias("claim"), F.array(F.col("event_id") % 20000).alias("pr_numbers"), F.array().cast("array<string>").alias("shas"))
    commits = adapt.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("sha"), F.array("o_orderkey").alias("pr_numbers"))
    return matching.anchors(claims, commits).select("claim", "sha")


@query("""
WITH c AS (SELECT md5(o_orderkey::VARCHAR) AS sha FROM orders), k AS (SELECT o_orderkey AS claim, substr(md5(o_orderkey::VARCHAR), 1, 7 + (o_orderkey % 6)::INT) AS cited FROM orders)
SELECT claim, sha FROM k JOIN c ON starts_with(sha, cited)
""")
def prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = adapt.table(spark, sf_dir, "orders")
    sha = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    commits = orders.select(sha.alias("sha"), F.array().cast("array<bigint>").alias("pr_numbers"))
    cited = F.substring(sha, F.lit(1), (7 + F.col("o_orderkey") % 6).cast("int"))
    claims = orders.select(F.col("o_orderkey").alias("claim"), F.array().cast("array<bigint>").alias("pr_numbers"), F.array(cited).alias("shas"))
    return matching.anchors(claims, commits).select("claim", "sha")


@query(f"""
WITH {TERMS_SQL}
SELECT doc_id, item_id, sum(CASE WHEN regexp_matches(term, '_|^--|[a-z][A-Z]|^[A-Za-z0-9_-]+\\.[a-z]{{1,4}}$|^\\d+\\.\\d+\\.\\d+|[/$@#%:]|[A-Za-z]\\d|\\d[A-Za-z]|-.*-') THEN 2 ELSE 1 END)::BIGINT AS score, count(*) AS terms
FROM documents JOIN t ON contains(text, term) GROUP BY doc_id, item_id HAVING score >= 2
""")
def lexical_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    needles = adapt.table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.terms(F.col("text"))).alias("term"))
    weight = T.term_weight(F.col("term"), F.array().cast("array<string>"))
    return matching.scored_pairs(adapt.table(spark, sf_dir, "documents"), needles.withColumn("weight", weight), "doc_id", "item_id", 2)


@query(f"""
WITH c AS (SELECT item_id AS claim, unnest({tokens_sql("text")}) AS token FROM benchmark), h AS (SELECT doc_id AS hunk, unnest({tokens_sql("text")}) AS token FROM documents),
n AS (SELECT count(DISTINCT hunk) AS total FROM h), d AS (SELECT token, count(*) AS df FROM h WHERE token IN (SELECT token FROM c) GROUP BY token),
s AS (SELECT claim, hunk, round(sum(ln(1 + total::DOUBLE / df)), 6) AS score FROM c JOIN d USING (token) JOIN h USING (token), n GROUP BY claim, hunk)
SELECT claim, hunk, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY score DESC, hunk) AS rank FROM s) WHERE rank <= 6
""")
def hunk_rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = adapt.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim"), F.explode(T.tokens(F.col("text"))).alias("token"))
    hunks = adapt.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("hunk"), F.explode(T.tokens(F.col("text"))).alias("token"))
    return matching.hunk_ranks(claims, hunks)


@query(f"""
WITH a AS (SELECT item_id AS a, unnest({tokens_sql("text")}) AS token FROM benchmark), b AS (SELECT doc_id AS b, unnest({tokens_sql("text")}) AS token FROM documents),
na AS (SELECT a, count(*) AS na FROM a GROUP BY a), nb AS (SELECT b, count(*) AS nb FROM b GROUP BY b),
s AS (SELECT a, b, count(*) AS n FROM a JOIN b USING (token) GROUP BY a, b), o AS (SELECT a, b, round(n::DOUBLE / least(na, nb), 6) AS overlap FROM s JOIN na USING (a) JOIN nb USING (b))
SELECT a, b, overlap, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY overlap DESC, b) AS rank FROM o WHERE overlap > 0.3) WHERE rank <= 3
""")
def related_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = adapt.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("a"), F.explode(T.tokens(F.col("text"))).alias("token"))
    right = adapt.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("b"), F.explode(T.tokens(F.col("text"))).alias("token"))
    return matching.related(left, right)


@query("""
WITH f AS (SELECT DISTINCT l_orderkey AS sha, l_partkey % 200 AS path FROM lineitem), m AS (SELECT DISTINCT l_suppkey % 50 AS claim, l_partkey % 200 AS path FROM lineitem WHERE l_quantity > 48)
SELECT f.sha, m.claim FROM f JOIN m USING (path) GROUP BY f.sha, m.claim HAVING count(*) = (SELECT count(*) FROM f g WHERE g.sha = f.sha)
""")
def breadth_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = adapt.table(spark, sf_dir, "lineitem")
    path = (F.col("l_partkey") % 200).alias("path")
    return matching.breadth_covered(line.select(F.col("l_orderkey").alias("sha"), path), line.where("l_quantity > 48").select((F.col("l_suppkey") % 50).alias("claim"), path))


@query(f"""
WITH {_FILES_SQL}, {_COMMITS_SQL}, churn AS (SELECT sha, sum(additions + deletions)::BIGINT AS churn FROM files GROUP BY sha)
SELECT sha, author, churn FROM commits JOIN churn USING (sha)
WHERE status <> 'P' AND sha NOT IN (SELECT sha FROM files WHERE additions >= 40 OR (verdict_code = 'R' AND discount > 0.05))
""")
def uncovered_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, commits = adapt.changed_files(spark, sf_dir), adapt.commits(spark, sf_dir).where("status <> 'P'")
    churn = files.groupBy("sha").agg(F.sum(F.col("additions") + F.col("deletions")).alias("churn"))
    left = matching.uncovered(commits, files.where("additions >= 40"), files.where("verdict_code = 'R' and discount > 0.05"))
    return left.join(churn, "sha").select("sha", "author", "churn")


@query(f"""
WITH {_FILES_SQL}, {_COMMITS_SQL}, k AS (SELECT sha, bool_or(discount > 0.08) AS noted FROM files GROUP BY sha), p AS (SELECT repo, sha, ({SHAPES_SQL})[1 + part % {len(SHAPES)}] AS path FROM files JOIN commits USING (sha) JOIN k USING (sha) WHERE NOT noted)
SELECT repo, category, count(*) AS files, count(DISTINCT sha) AS commits FROM (SELECT repo, sha, {sensitive_sql("path")} AS category FROM p) WHERE category IS NOT NULL GROUP BY repo, category
""")
def sensitive_undocumented(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, commits = adapt.changed_files(spark, sf_dir), adapt.commits(spark, sf_dir).select("sha", "repo")
    noted = files.groupBy("sha").agg(F.bool_or(F.col("discount") > 0.08).alias("noted")).where("not noted").select("sha")
    kind = T.sensitive_category(F.get(F.array(*[F.lit(x) for x in SHAPES]), (F.col("part") % len(SHAPES)).cast("int")))
    rows = files.join(noted, "sha").join(commits, "sha").select("repo", "sha", kind.alias("category")).where("category is not null")
    return rows.groupBy("repo", "category").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("sha").alias("commits"))


@query("""
WITH k AS (SELECT doc_id, trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')) AS key FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
e AS (SELECT DISTINCT key FROM k WHERE doc_id % 2 = 0 AND len(string_split(key, ' ')) >= 4)
SELECT doc_id, key FROM k WHERE doc_id % 2 = 1 AND key IN (SELECT key FROM e)
""")
def carried_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one half of the documents (a release) that stood in the other half (its base)."""
    lines = adapt.lines(spark, sf_dir).withColumnRenamed("line", "text")
    return matching.carried_over(lines.where("doc_id % 2 = 1"), lines.where("doc_id % 2 = 0")).select("doc_id", "key")


@query("""
WITH e AS (SELECT l_suppkey % 100 AS file, l_partkey % 50 AS name, l_orderkey * 10 + l_linenumber AS ord, '1.' || (l_quantity::BIGINT % 9) AS version, l_returnflag = 'R' AS old FROM lineitem),
o AS (SELECT file, name, arg_max(version, row(ord, version)) AS "from" FROM e WHERE old GROUP BY file, name),
n AS (SELECT file, name, "from", arg_min(version, row(ord, version)) AS "to" FROM e JOIN o USING (file, name) WHERE NOT old AND version <> "from" GROUP BY ALL)
SELECT * FROM n
""")
def pin_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = adapt.table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 100).alias("file"), (F.col("l_partkey") % 50).alias("name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        F.concat(F.lit("1."), (F.col("l_quantity").cast("long") % 9).cast("string")).alias("version"), (F.col("l_returnflag") == "R").alias("old"),
    )
    return matching.last_then_first_differing(entries.where("old"), entries.where("not old"))


@query("""
WITH pins AS (SELECT DISTINCT p_brand AS name, p_size % 7 AS a, p_size % 11 AS b FROM part WHERE a <> b), c AS (SELECT p_partkey AS claim, p_brand AS name, p_size % 9 AS said FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY CASE WHEN b = said THEN 0 ELSE 1 END, b DESC, a) AS k FROM c LEFT JOIN pins USING (name))
SELECT claim, CASE WHEN b IS NULL THEN 'unmatched' WHEN b = said THEN 'confirmed' WHEN b > said AND a < said THEN 'overtaken' ELSE 'contradicted' END AS verdict, '2.' || a AS pin_from, '2.' || b AS pin_to FROM r WHERE k = 1
""")
def bump_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = adapt.table(spark, sf_dir, "part")
    version = lambda c: F.concat(F.lit("2."), c.cast("string"))
    a, b = F.col("p_size") % 7, F.col("p_size") % 11
    moved = part.where(a != b).select(F.col("p_brand").alias("name"), version(a).alias("from"), version(b).alias("to")).distinct()
    claims = part.select(F.col("p_partkey").alias("claim"), F.col("p_brand").alias("name"), version(F.col("p_size") % 9).alias("to"))
    return pins.bump_verdicts(claims, moved).select("claim", "verdict", "pin_from", "pin_to")


@query(f"""
WITH {_COMMITS_SQL}, y AS (SELECT repo, author, min(committed_at) AS first FROM commits GROUP BY ALL), f AS (SELECT DISTINCT l_orderkey AS sha FROM lineitem WHERE l_discount >= 0.09)
SELECT repo, author, count(*) AS commits FROM commits JOIN y USING (repo, author) WHERE year(first) >= 1996 AND sha IN (SELECT sha FROM f) GROUP BY repo, author
""")
def new_authors_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = adapt.commits(spark, sf_dir)
    known = commits.where(F.year("committed_at") < 1996).select("repo", "author").distinct()
    touched = adapt.table(spark, sf_dir, "lineitem").where("l_discount >= 0.09").select(F.col("l_orderkey").alias("sha"))
    fresh = commits.join(known, ["repo", "author"], "left_anti").join(touched, "sha", "left_semi")
    return fresh.groupBy("repo", "author").agg(F.count(F.lit(1)).alias("commits"))


@query("""
WITH e AS (SELECT o_custkey AS email, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS login, o_orderdate AS seen, o_orderkey AS sha FROM orders),
k AS (SELECT email, arg_max(login, row(seen, sha)) AS known FROM e WHERE year(seen) < 1996 AND login IS NOT NULL GROUP BY email)
SELECT sha, email, login, known FROM e JOIN k USING (email) WHERE year(seen) >= 1996 AND login IS NOT NULL AND login <> known
""")
def account_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapt.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("email"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("login"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("sha")
    )
    stated = rows.where("login is not null")  # a source that cannot say is no mismatch
    known = stated.where(F.year("at") < 1996).groupBy("email").agg(F.max_by("login", F.struct("at", "sha")).alias("known"))
    return stated.where(F.year("at") >= 1996).join(known, "email").where("login <> known").select("sha", "email", "login", "known")


@query("""
WITH e AS (SELECT DISTINCT p_name AS name, s_nationkey AS root, year(l_shipdate) AS y FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
k AS (SELECT * FROM e WHERE y < 1993)
SELECT DISTINCT name, root FROM e WHERE y >= 1993 AND name NOT IN (SELECT name FROM k) AND root NOT IN (SELECT root FROM k WHERE root % 2 = 0)
""")
def new_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part, supplier = (adapt.table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    entries = (
        line.join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey)
        .select(F.col("p_name").alias("name"), F.col("s_nationkey").alias("root"), F.year("l_shipdate").alias("y")).distinct()
    )
    known = entries.where("y < 1993").select("name", F.when(F.col("root") % 2 == 0, F.col("root")).alias("root"))
    return pins.new_suppliers(entries.where("y >= 1993"), known.where("name is not null")).select("name", "root").distinct()


@query("""
WITH h AS (SELECT page_id % 20 AS release, regexp_extract(lower(url), '^https?://([^/]+)', 1) AS host, page_id % 3 > 0 AS plus FROM pages),
s AS (SELECT release, coalesce(list(DISTINCT host) FILTER (plus), []) AS p, coalesce(list(DISTINCT host) FILTER (NOT plus), []) AS m FROM h GROUP BY release)
SELECT release, list_sort(list_filter(p, lambda x: NOT list_contains(m, x))) AS appeared, list_sort(list_filter(m, lambda x: NOT list_contains(p, x))) AS gone FROM s
""")
def host_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapt.table(spark, sf_dir, "pages").select((F.col("page_id") % 20).alias("release"), F.regexp_extract(F.lower("url"), "^https?://([^/]+)", 1).alias("host"), (F.col("page_id") % 3 > 0).alias("plus"))
    return surface.delta(rows, "release", "host", F.col("plus"))


@query("""
WITH k AS (SELECT source AS release, unnest(regexp_extract_all(text, '[A-Z][a-z]{9,}')) AS name, lang <> 'en' AS plus FROM documents),
s AS (SELECT release, coalesce(list(DISTINCT name) FILTER (plus), []) AS p, coalesce(list(DISTINCT name) FILTER (NOT plus), []) AS m FROM k GROUP BY release)
SELECT release, len(list_filter(p, lambda x: NOT list_contains(m, x))) AS appeared, len(list_filter(m, lambda x: NOT list_contains(p, x))) AS gone FROM s
""")
def surface_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = adapt.table(spark, sf_dir, "documents")
    rows = docs.select(F.col("source").alias("release"), F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{9,}"), 0)).alias("name"), (F.col("lang") != "en").alias("plus"))
    found = surface.delta(rows, "release", "name", F.col("plus"))
    return found.select("release", F.size("appeared").cast("long").alias("appeared"), F.size("gone").cast("long").alias("gone"))


@query("""
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/(.*)$', 1) AS path FROM pages),
h AS (SELECT page_id, 'any' AS rule FROM p WHERE path <> '' UNION ALL SELECT page_id, 'numbered' FROM p WHERE regexp_matches(path, '^[^/]*1[^/]*(/|$)') UNION ALL SELECT page_id, 'deep' FROM p WHERE regexp_matches(path, '^[^/]+/[^/]+(/|$)'))
SELECT rule, count(*) AS hits, min(page_id) AS first_page FROM h GROUP BY rule
""")
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = adapt.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/]+/(.*)$", 1).alias("path")).where("path <> ''")
    rules = [("any", "**"), ("numbered", "*1*"), ("deep", "*/*")]
    return surface.rule_hits(facts, rules, "path").groupBy("rule").agg(F.count(F.lit(1)).alias("hits"), F.min("page_id").alias("first_page"))
