"""Queries on texts: dedupe, promises, versions, noise, parsing, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import adapt
from ..functions import repair
from ..functions import text as T
from ..operators import matching
from ..registry import query
from ..stored import stored
from ..sources import notes
from ..streaming import ledger
from .sql import TERMS_SQL


@query("""
SELECT doc_id, key FROM (SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS key, row_number() OVER (PARTITION BY trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) ORDER BY doc_id) AS k FROM documents) WHERE k = 1
""")
def corpus_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each normalized text; an aggregate with map-side combine, no window over copies."""
    keyed = adapt.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalized(F.col("text")).cast("binary")).alias("key"))
    return keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "key")


@query(f"""
WITH {TERMS_SQL}, h AS (SELECT item_id, count(DISTINCT CASE WHEN lang = 'en' THEN term END) AS plus, count(DISTINCT CASE WHEN lang <> 'en' THEN term END) AS minus FROM t JOIN documents ON contains(text, term) GROUP BY item_id),
i AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'removal' ELSE 'addition' END AS kind, coalesce(plus, 0) AS plus, coalesce(minus, 0) AS minus FROM benchmark LEFT JOIN h USING (item_id))
SELECT item_id, kind, CASE WHEN kind = 'addition' AND plus > 0 THEN 'kept' WHEN kind = 'removal' AND minus > 0 THEN 'kept' ELSE 'open' END AS state, plus, minus FROM i
""")
def promise_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of promises found inside texts of the side that proves them: additions or removals; others stay open."""
    kind = F.when(F.col("item_id") % 3 == 0, "removal").otherwise("addition").alias("kind")
    items = adapt.table(spark, sf_dir, "benchmark").select("item_id", "text", kind)
    promised = items.select("item_id", F.explode(T.terms(F.col("text"))).alias("term"))
    seen = adapt.table(spark, sf_dir, "documents").select((F.col("lang") == "en").alias("plus"), "text")
    sides = matching.contained_terms(seen, promised, "plus", "item_id").groupBy("item_id").agg(F.count_if("plus").alias("plus"), F.count_if(~F.col("plus")).alias("minus"))
    met = items.select("item_id", "kind").join(sides, "item_id", "left").na.fill(0, ["plus", "minus"])
    kept = ((F.col("kind") == "addition") & (F.col("plus") > 0)) | ((F.col("kind") == "removal") & (F.col("minus") > 0))
    return met.select("item_id", "kind", F.when(kept, "kept").otherwise("open").alias("state"), "plus", "minus")


@query("""
WITH v AS (SELECT p_partkey, [p_size % 4, p_size % 3, p_partkey % 5] AS a, [p_size % 4, p_partkey % 3, p_size % 5] AS b, p_partkey % 6 = 0 AS short FROM part)
SELECT p_partkey, CASE WHEN a[1] <> b[1] THEN sign(a[1] - b[1]) WHEN a[2] <> b[2] THEN sign(a[2] - b[2]) WHEN short THEN CASE WHEN a[3] = 0 THEN 0 ELSE 1 END ELSE sign(a[3] - b[3]) END::INT AS ordered FROM v
""")
def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = adapt.table(spark, sf_dir, "part")
    dotted = lambda *c: F.concat_ws(".", *[x.cast("string") for x in c])
    s, k = F.col("p_size"), F.col("p_partkey")
    a = F.concat(F.lit("v"), dotted(s % 4, s % 3, k % 5))
    b = F.when(k % 6 == 0, dotted(s % 4, k % 3)).otherwise(dotted(s % 4, k % 3, s % 5))
    return part.select("p_partkey", T.compare_versions(a, b).alias("ordered"))


@query("""
WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS token FROM documents), c AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS token FROM benchmark)
SELECT token, count(*) AS n FROM t WHERE token NOT IN (SELECT token FROM c) GROUP BY token ORDER BY n DESC, token LIMIT 20
""")
def noise_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0))
    seen = adapt.table(spark, sf_dir, "documents").select(F.explode(words).alias("token"))
    claimed = adapt.table(spark, sf_dir, "benchmark").select(F.explode(words).alias("token")).distinct()
    return seen.join(claimed, "token", "left_anti").groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(20)


@query(f"""
WITH {TERMS_SQL}, s AS (SELECT item_id, doc_id, 2 * count(*) AS score FROM t JOIN documents ON contains(text, term) GROUP BY ALL), p AS (SELECT * FROM s WHERE score >= 3)
SELECT 'confirmed' AS state, count(*) AS n FROM p UNION ALL SELECT 'undocumented', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM p)
UNION ALL SELECT 'unsupported', count(*) FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM p)
""")
def reconcile_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings and claims paired by shared identifiers; what stays alone on either side."""
    claims, findings = adapt.table(spark, sf_dir, "benchmark"), adapt.table(spark, sf_dir, "documents")
    asked = claims.select("item_id", T.code_spans(F.col("text")).alias("spans"), F.explode(T.terms(F.col("text"))).alias("term"))
    asked = asked.select("item_id", "term", F.array_contains("spans", F.col("term")).alias("spanned"))
    # three branches read the pairs, of which they need the keys
    paired = stored(matching.confirmed_pairs(findings.select("doc_id", "text"), asked, "doc_id", "item_id").select("doc_id", "item_id"), "pairs")
    count = lambda name, df: df.agg(F.lit(name).alias("state"), F.count(F.lit(1)).alias("n"))
    return (
        count("confirmed", paired)
        .unionByName(count("undocumented", findings.join(paired.select("doc_id"), "doc_id", "left_anti")))
        .unionByName(count("unsupported", claims.join(paired.select("item_id"), "item_id", "left_anti")))
    )


@query("""
WITH d AS (SELECT doc_id, CASE WHEN contains(text, 'th') THEN 1 ELSE 0 END AS th, length(text) AS n FROM documents)
SELECT doc_id, n::BIGINT AS n, CASE WHEN n > 500 THEN 513 ELSE n END::BIGINT AS shown FROM d
""")
def truncate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = adapt.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.length("text").cast("long").alias("n"), F.length(T.truncated(F.col("text"), 500)).cast("long").alias("shown"))


@query("""
SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS shown FROM pages
""")
def escape_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt.table(spark, sf_dir, "pages").select("page_id", T.escaped(F.col("html")).alias("shown"))


@query("""
SELECT c_custkey, 'redacted:' || substr(sha256(lower(c_name)), 1, 12) AS identity FROM customer
""")
def redact_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt.table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("redacted:"), F.substring(F.sha2(F.lower("c_name"), 256), 1, 12)).alias("identity"))


@query("""
WITH l AS (SELECT source, n_chars, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM documents)
SELECT source, doc_id, greatest(0, least(n_chars, 20000 - (upto - n_chars)))::BIGINT AS allotted FROM l WHERE upto - n_chars < 20000
""")
def budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running length until a budget is spent, the last one clipped."""
    upto = F.sum("n_chars").over(Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = adapt.table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", upto.alias("upto")).withColumn("before", F.col("upto") - F.col("n_chars"))
    return rows.where("before < 20000").select("source", "doc_id", F.least("n_chars", 20000 - F.col("before")).cast("long").alias("allotted"))


@query("SELECT user_id, count(*) AS rows, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY user_id")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties, their closing brace cut off as a model's output may be, repaired and read."""
    cut = F.regexp_replace("props", "\\}\\s*\\z", "")
    rows = adapt.table(spark, sf_dir, "events").select("user_id", F.from_json(repair.repaired(cut), "k long").alias("x"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("x.k").alias("total"))


@query()
def parse_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as notes; tested against worked examples."""
    docs = adapt.table(spark, sf_dir, "documents")
    return notes.claims_of(docs.select(F.col("doc_id").cast("string").alias("release"), F.col("text").alias("notes"))).select("release", "id", "section", "text", "kind", "pr_numbers")


@query()
def dedupe_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent groups of lines sharing parts, per supplier; tested against worked examples."""
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("claim").reset_index(drop=True)
        groups = notes.number_groups([list(x) for x in pdf["numbers"]])
        where = {k: g for g, members in enumerate(groups) for k in members}
        return pd.DataFrame({"supplier": pdf["supplier"], "claim": pdf["claim"], "grp": [where.get(k, -1) for k in range(len(pdf))]})

    rows = adapt.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier"), F.col("l_orderkey").alias("claim")).agg(F.collect_set(F.col("l_partkey") % 300).alias("numbers"))
    return rows.groupBy("supplier").applyInPandas(fold, "supplier long, claim long, grp long")


@query("""
SELECT entry, cursor_tag, checked, top_label FROM (
  SELECT user_id AS entry, arg_max(event_id, row(ts, event_id)) AS cursor_tag, count(*) AS checked, max(event_type) AS top_label FROM events GROUP BY user_id)
""")
def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of the streaming ledger; tests replay the same rows as a stream."""
    return ledger.ledger_of(adapt.checks(spark, sf_dir))
