"""Queries on series of checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import adapt
from ..operators import history, longview
from ..registry import query
from ..stored import stored
from ..streaming import watch

_CHECKS = "checks AS (SELECT user_id AS entry, event_id AS tag, ts AS published_at, least(100, floor(value))::BIGINT AS score, event_type AS label, (event_type = 'error')::INT AS unjudged FROM events)"
ORDER = ("published_at", "tag")


@query(f"""
WITH {_CHECKS}, w AS (SELECT *, median(score) OVER b AS m, count(*) OVER b AS n FROM checks WINDOW b AS (PARTITION BY entry ORDER BY published_at, tag ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT entry, tag, score, CASE WHEN n >= 3 THEN round(m)::BIGINT END AS level, coalesce(CASE WHEN n >= 3 THEN score <= round(m) - 20 END, false) AS dropped FROM w
""")
def baseline_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.baseline_level(adapt.checks(spark, sf_dir), *ORDER).select("entry", "tag", "score", "level", "dropped")


@query(f"""
WITH {_CHECKS}, w AS (SELECT entry, tag, list(score) OVER (PARTITION BY entry ORDER BY published_at, tag ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS l FROM checks),
h AS (SELECT entry, tag, CASE WHEN len(l) >= 6 THEN round(list_aggregate(l[1:len(l) // 2], 'median'))::BIGINT END AS older, CASE WHEN len(l) >= 6 THEN round(list_aggregate(l[len(l) - len(l) // 2 + 1:], 'median'))::BIGINT END AS newer FROM w)
SELECT entry, tag, older, newer, coalesce(older - newer >= 20, false) AS drifted FROM h
""")
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.drift(adapt.checks(spark, sf_dir), *ORDER).select("entry", "tag", "older", "newer", "drifted")


@query(f"""
WITH {_CHECKS}, m AS (SELECT *, sum(1 - unjudged) OVER (PARTITION BY entry ORDER BY published_at, tag) AS miss FROM checks)
SELECT entry, tag, streak, streak >= 3 AS softened FROM (SELECT entry, tag, (sum(unjudged) OVER (PARTITION BY entry, miss ORDER BY published_at, tag))::BIGINT AS streak FROM m)
""")
def softening_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.trailing_streak(adapt.checks(spark, sf_dir), F.col("unjudged") > 0, *ORDER)
    return rows.select("entry", "tag", F.col("streak").cast("long").alias("streak"), (F.col("streak") >= 3).alias("softened"))


@query(f"""
WITH {_CHECKS}, c AS (SELECT *, CASE WHEN lag(label) OVER w = label THEN 0 ELSE 1 END AS c FROM checks WINDOW w AS (PARTITION BY entry ORDER BY published_at, tag)),
r AS (SELECT *, sum(c) OVER (PARTITION BY entry ORDER BY published_at, tag) AS run FROM c)
SELECT entry, run::BIGINT AS run, any_value(label) AS label, min(tag) AS from_tag, max(tag) AS to_tag, count(*) AS checks FROM r GROUP BY entry, run
""")
def generation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.runs(adapt.checks(spark, sf_dir), "label", *ORDER).withColumn("run", F.col("run").cast("long"))


@query(f"""
WITH {_CHECKS}, g AS (SELECT entry, epoch_us(published_at) - epoch_us(lag(published_at) OVER (PARTITION BY entry ORDER BY published_at, tag)) AS us FROM checks)
SELECT entry, count(us) AS gaps, ((2 * median(us))::BIGINT + 86400) // 172800 / 1000000.0::DOUBLE AS median_days, (2 * max(us) + 86400) // 172800 / 1000000.0::DOUBLE AS longest FROM g GROUP BY entry
""")
def cadence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps in days, to six places; rounded on whole half microseconds, so that no binary fraction decides a half."""
    at = F.unix_micros(F.col("published_at").cast("timestamp"))
    gap = at - F.lag(at).over(Window.partitionBy("entry").orderBy(*ORDER))
    days = lambda twice: F.expr(f"({twice} + 86400) div 172800") / 1000000.0
    gaps = adapt.checks(spark, sf_dir).select("entry", gap.alias("us")).groupBy("entry").agg(F.count("us").alias("gaps"), F.median("us").alias("median"), F.max("us").alias("longest"))
    return gaps.select("entry", "gaps", days("cast(2 * median as bigint)").alias("median_days"), days("2 * longest").alias("longest"))


@query(f"""
WITH {_CHECKS}, r AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY published_at DESC, tag DESC) AS age, count(*) OVER (PARTITION BY entry) AS n FROM checks)
SELECT entry, tag, age, greatest(0, n - 20) AS skipped FROM r WHERE age <= 20
""")
def history_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = adapt.checks(spark, sf_dir)
    kept = history.newest(checks, 20, *ORDER).select("entry", "tag", F.col("age").cast("long").alias("age"))
    sizes = checks.groupBy("entry").agg(F.greatest(F.lit(0), F.count(F.lit(1)) - 20).cast("long").alias("skipped"))
    return kept.join(sizes, "entry")


@query(f"""
WITH {_CHECKS}, cur AS (SELECT entry, max(published_at) FILTER (score >= 50) AS cursor FROM checks GROUP BY entry)
SELECT c.entry, c.tag FROM checks c JOIN cur USING (entry) WHERE c.published_at <= cursor AND c.label <> 'error'
  AND NOT EXISTS (SELECT 1 FROM checks d WHERE d.entry = c.entry AND d.tag = c.tag AND d.score >= 50)
""")
def backfill_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = adapt.checks(spark, sf_dir)
    done = checks.where("score >= 50")
    cursor = done.groupBy("entry").agg(F.max("published_at").alias("cursor"))
    eligible = checks.where("label <> 'error'").join(cursor, "entry").where("published_at <= cursor")
    return eligible.join(done.select("entry", "tag"), ["entry", "tag"], "left_anti").select("entry", "tag")


@query(f"""
WITH {_CHECKS}, c AS (SELECT entry, label, count(*) AS n, min(tag) AS seen FROM checks GROUP BY entry, label)
SELECT entry, label, n FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY n DESC, seen) AS k FROM c) WHERE k = 1
""")
def mode_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.first_seen_mode(adapt.checks(spark, sf_dir), "entry", "label", "tag")


@query("""
WITH r AS (SELECT o_custkey AS line, year(o_orderdate) AS major, o_orderkey AS tag, o_orderstatus <> 'P' AS usable, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ord FROM orders)
SELECT a.line, a.tag, coalesce(
  (SELECT arg_max(b.tag, b.ord) FROM r b WHERE b.line = a.line AND b.major = a.major AND b.ord < a.ord AND b.usable),
  (SELECT arg_max(b.tag, b.ord) FROM r b WHERE b.line = a.line AND b.ord < a.ord AND b.usable)) AS base FROM r a
""")
def asof_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = adapt.table(spark, sf_dir, "orders")
    releases = orders.select(
        F.col("o_custkey").alias("line"), F.year("o_orderdate").alias("major"), F.col("o_orderkey").alias("tag"), (F.col("o_orderstatus") != "P").alias("usable"),
        F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("ord"),
    )
    return history.base_release(releases).select("line", "tag", "base")


@query("SELECT o_custkey AS line, o_orderkey AS tag, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_tag FROM orders")
def consecutive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return adapt.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("line"), F.col("o_orderkey").alias("tag"), F.lead("o_orderkey").over(w).alias("next_tag"))


@query("""
WITH m AS (SELECT c_nationkey AS repo, year(o_orderdate) AS year, month(o_orderdate) AS month, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey),
years AS (SELECT DISTINCT repo, year FROM m), cal AS (SELECT repo, year, unnest(range(1, 13)) AS month FROM years),
g AS (SELECT repo, year, month, count(*) AS n, min(v) AS least, median(v) AS middle, max(v) AS most FROM m GROUP BY ALL)
SELECT repo::INT AS repo, year::INT AS year, month::INT AS month, coalesce(n, 0) AS n, least, round(middle, 4) AS middle, most FROM cal LEFT JOIN g USING (repo, year, month)
""")
def year_month_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = adapt.commits(spark, sf_dir).select("repo", F.year("committed_at").alias("year"), F.month("committed_at").alias("month"), "worth")
    grouped = commits.groupBy("repo", "year", "month").agg(
        F.count(F.lit(1)).alias("n"), F.min("worth").alias("least"), F.round(F.median("worth"), 4).alias("middle"), F.max("worth").alias("most")
    )
    calendar = commits.select("repo", "year").distinct().withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return calendar.join(grouped, ["repo", "year", "month"], "left").na.fill(0, ["n"])


@query("""
WITH a AS (SELECT c_nationkey AS entry, o_custkey AS identity, count(*) AS commits, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT entry, identity, commits, strftime(first_seen, '%Y-%m-%d') AS first_seen, strftime(last_seen, '%Y-%m-%d') AS last_seen, place
FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY commits DESC, identity) AS place FROM a) WHERE place <= 100
""")
def author_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    activity = adapt.commits(spark, sf_dir).select(F.col("repo").alias("entry"), F.col("author").alias("identity"), F.col("committed_at").alias("at"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return history.author_ledger(activity).select("entry", "identity", "commits", day("first_seen"), day("last_seen"), F.col("place").cast("long").alias("place"))


@query("""
WITH f AS (SELECT c_nationkey AS repo, o_custkey AS author, count(*) AS files, sum(CAST(l_quantity AS BIGINT)) AS churn FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT repo, author, files, churn::BIGINT AS churn, round(files::DOUBLE / sum(files) OVER (PARTITION BY repo), 6) AS share FROM f
""")
def author_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapt.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_quantity").cast("long").alias("churn"))
    per = files.join(adapt.commits(spark, sf_dir).select("sha", "repo", "author"), "sha").groupBy("repo", "author").agg(F.count(F.lit(1)).alias("files"), F.sum("churn").alias("churn"))
    return per.withColumn("share", F.round(F.col("files") / F.sum("files").over(Window.partitionBy("repo")), 6))


@query(f"""
WITH {_CHECKS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY published_at DESC, tag DESC) AS k FROM checks) WHERE k = 1)
SELECT entry, tag, score, label = 'error' AS flagged, CASE WHEN score >= 85 THEN 'solid' WHEN score >= 65 THEN 'minor gaps' WHEN score >= 45 THEN 'questionable' ELSE 'suspicious' END AS bucket
FROM l ORDER BY (label = 'error') DESC, published_at DESC, tag LIMIT 30
""")
def feed_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.scoring import score_label

    latest = adapt.checks(spark, sf_dir).groupBy("entry").agg(F.max(F.struct("published_at", "tag", "score", "label")).alias("m")).select("entry", "m.*")
    flagged = (F.col("label") == "error").alias("flagged")
    return latest.orderBy(F.desc(flagged), F.desc("published_at"), "tag").limit(30).select("entry", "tag", "score", flagged, score_label(F.col("score")).alias("bucket"))


@query(f"""
WITH {_CHECKS}, d AS (SELECT DISTINCT entry, label || ':' || (score // 10) AS m FROM checks), r AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY m) AS k, count(*) OVER (PARTITION BY entry) AS n FROM d)
SELECT entry, list(m ORDER BY m) FILTER (k <= 12) AS matched, max(greatest(0, n - 12)) AS more FROM r GROUP BY entry
""")
def severity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = adapt.checks(spark, sf_dir).select("entry", F.concat_ws(":", "label", F.floor(F.col("score") / 10).cast("string")).alias("m"))
    grouped = marks.groupBy("entry").agg(F.array_sort(F.collect_set("m")).alias("all"))
    return grouped.select("entry", F.slice("all", 1, 12).alias("matched"), F.greatest(F.lit(0), F.size("all") - 12).cast("long").alias("more"))


@query()
def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential segmentation of each series; tested against worked examples."""
    checks = adapt.checks(spark, sf_dir)
    ordered = F.row_number().over(Window.partitionBy("entry").orderBy(*ORDER))
    rows = checks.select(
        "entry", "tag", ordered.cast("long").alias("ord"), "score", F.lit(1).alias("generation"), F.col("label").alias("top"),
        (F.col("score") / 100.0).alias("share"), (F.unix_millis(F.col("published_at").cast("timestamp")) / 86400000.0).alias("day"),
    )
    return history.phases(rows)


@query(f"""
WITH {_CHECKS}, r AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY published_at, tag) AS run FROM checks),
w AS (SELECT *, median(score) OVER b AS m, count(*) OVER b AS n, list(score) OVER (PARTITION BY entry ORDER BY run ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS l,
      sum(unjudged) OVER (PARTITION BY entry ORDER BY run ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS softened FROM r WINDOW b AS (PARTITION BY entry ORDER BY run ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
d AS (SELECT entry, tag, score, softened, CASE WHEN n >= 3 THEN round(m)::BIGINT END AS level,
      len(l) >= 6 AND round(list_aggregate(l[1:len(l) // 2], 'median')) - round(list_aggregate(l[len(l) - len(l) // 2 + 1:], 'median')) >= 20 AS drifted FROM w)
SELECT entry, tag::VARCHAR AS tag, level, drifted, drifted OR softened OR CASE WHEN level IS NULL THEN score < 65 ELSE score <= level - 20 END AS flagged FROM d
""")
def watch_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert decisions of every check, folded entry by entry; tests replay the same runs as a stream."""
    run = F.row_number().over(Window.partitionBy("entry").orderBy(*ORDER)).cast("long")
    runs = adapt.checks(spark, sf_dir).select(
        "entry", F.col("tag").cast("string").alias("tag"), F.col("published_at").cast("timestamp").alias("published_at"), run.alias("run"), "score",
        F.lit(0).cast("long").alias("exit_code"), F.lit(0).cast("long").alias("critical"), F.col("unjudged").cast("long").alias("unjudged"), F.lit(0).cast("long").alias("rule_hits"),
    )
    return watch.decisions(runs).select("entry", "tag", "level", "drifted", "flagged")


# Phases by a recursion from phase to phase: every later place is judged by what stands before it in the open phase and what follows it.
_PHASES = f"""{_CHECKS},
b AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY published_at, tag) - 1 AS pos, count(*) OVER w AS n, median(score) OVER w AS m,
      sum(1 - unjudged) OVER (PARTITION BY entry ORDER BY published_at, tag) AS miss FROM checks WINDOW w AS (PARTITION BY entry ORDER BY published_at, tag ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
v AS (SELECT entry, tag, published_at, pos, score, label, label AS top, score / 128.0::DOUBLE AS share, (epoch_us(published_at) // 3600000000)::DOUBLE AS day,
      n >= 3 AND coalesce(score <= round(m) - 20, false) AS flagged, sum(unjudged) OVER (PARTITION BY entry, miss ORDER BY pos) AS streak FROM b),
c AS (SELECT *, CASE WHEN streak >= 2 THEN streak ELSE 0 END AS critical, CASE WHEN lag(label) OVER (PARTITION BY entry ORDER BY pos) = 'signup' AND label = 'purchase' THEN 1 ELSE 0 END AS broken,
      count(*) OVER (PARTITION BY entry, date_trunc('day', published_at)) AS authors FROM v),
l AS (SELECT entry, list(score::DOUBLE ORDER BY pos) AS sc, list(top ORDER BY pos) AS tp, list(share ORDER BY pos) AS sh, list(day ORDER BY pos) AS dy, count(*) AS n FROM c GROUP BY entry),
g AS (SELECT *, list_transform(range(1, n), lambda k: dy[k + 1] - dy[k]) AS ga FROM l),
ph AS (SELECT entry, 0::BIGINT AS pos, 0::BIGINT AS phase, []::STRUCT(kind VARCHAR, old VARCHAR, new VARCHAR)[] AS reasons FROM l
  UNION ALL SELECT entry, (x.i + coalesce(CASE
      WHEN x.r1 THEN list_position(list_transform(x.asc_, lambda v: abs(v - x.l1) <= abs(v - x.l0)), true) WHEN x.r2 THEN list_position(x.atp, x.t1)
      WHEN x.r3 THEN list_position(list_transform(x.ash, lambda v: abs(v - x.h1) <= abs(v - x.h0)), true) END, 1) - 1)::BIGINT, phase + 1, list_filter([
      CASE WHEN x.r1 THEN {{'kind': 'level', 'old': floor(x.l0 + 0.5)::BIGINT::VARCHAR, 'new': floor(x.l1 + 0.5)::BIGINT::VARCHAR}} END,
      CASE WHEN x.r2 THEN {{'kind': 'author', 'old': x.t0, 'new': x.t1}} END,
      CASE WHEN x.r3 THEN {{'kind': 'share', 'old': floor(x.h0 * 100 + 0.5)::BIGINT || '%', 'new': floor(x.h1 * 100 + 0.5)::BIGINT || '%'}} END,
      CASE WHEN x.r4 THEN {{'kind': 'cadence', 'old': floor(x.g0 + 0.5)::BIGINT::VARCHAR, 'new': floor(x.g1 + 0.5)::BIGINT::VARCHAR}} END], lambda r: r IS NOT NULL)
    FROM (SELECT entry, phase, arg_min(k, i) AS x FROM (
        SELECT *, abs(l1 - l0) >= 20 AS r1, t0 <> t1 AND len(list_filter(atp, lambda v: v = t1)) >= 2 AS r2, abs(h1 - h0) >= 0.35 AS r3, least(g0, g1) >= 1 AND greatest(g0, g1) >= 3 * least(g0, g1) AS r4
        FROM (SELECT entry, phase, i, sc[i + 1:i + 3] AS asc_, tp[i + 1:i + 3] AS atp, sh[i + 1:i + 3] AS ash, list_median(sc[greatest(s, i - 5) + 1:i]) AS l0, list_median(sc[i + 1:i + 3]) AS l1,
            list_aggregate(tp[s + 1:i], 'mode') AS t0, list_aggregate(tp[i + 1:i + 3], 'mode') AS t1, list_median(sh[s + 1:i]) AS h0, list_median(sh[i + 1:i + 3]) AS h1, list_median(ga[s + 1:i - 1]) AS g0, list_median(ga[i:i + 2]) AS g1
          FROM (SELECT g.*, ph.phase, ph.pos AS s, unnest(range(ph.pos + 3, g.n - 2)) AS i FROM ph JOIN g ON g.entry = ph.entry))) k
      WHERE r1 OR r2 OR r3 OR r4 GROUP BY entry, phase))"""


def _record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of every entry: alerts of the series itself, runs of errors as critical flags, a purchase after a signup as a broken promise; hours stand for days.

    Shares are 128ths, so that medians are exact in binary."""
    rows = history.trailing_streak(history.baseline_level(adapt.checks(spark, sf_dir), *ORDER), F.col("unjudged") > 0, *ORDER)
    w = Window.partitionBy("entry").orderBy(*ORDER)
    after_signup = (F.lag("label").over(w) == "signup") & (F.col("label") == "purchase")
    at = F.col("published_at").cast("timestamp")
    return rows.select(
        "entry", "tag", F.row_number().over(w).cast("long").alias("ord"), at.alias("published_at"), "score", "label", F.lit(1).alias("generation"), F.col("label").alias("top"),
        (F.col("score") / 128.0).alias("share"), F.floor(F.unix_micros(at) / 3600000000).cast("double").alias("day"), F.col("dropped").alias("flagged"),
        F.when(F.col("streak") >= 2, F.col("streak")).otherwise(0).cast("long").alias("critical"), F.when(after_signup, 1).otherwise(0).cast("long").alias("broken"),
        F.count(F.lit(1)).over(Window.partitionBy("entry", F.date_trunc("day", at))).alias("authors"),
    )


@query(f"""
WITH RECURSIVE {_PHASES}, o AS (SELECT c.*, (SELECT max(phase) FROM ph WHERE ph.entry = c.entry AND ph.pos <= c.pos) AS phase FROM c),
d AS (SELECT *, day - lag(day) OVER (PARTITION BY entry, phase ORDER BY pos) AS gap FROM o),
s AS (SELECT entry, phase, arg_min(tag, pos) AS from_tag, arg_max(tag, pos) AS to_tag, count(*) AS checks, floor(median(score) + 0.5)::BIGINT AS score, min(score) AS least, max(score) AS most,
      floor(median(authors) + 0.5)::BIGINT AS authors, floor(median(share) * 100 + 0.5)::BIGINT AS share, floor(median(gap) + 0.5)::BIGINT AS gap_days,
      count(*) FILTER (flagged) AS flagged, sum(critical)::BIGINT AS critical, sum(broken)::BIGINT AS broken FROM d GROUP BY entry, phase)
SELECT s.*, array_to_string(list_transform(reasons, lambda r: r.kind || ' ' || r.old || ' ' || r.new), '; ') AS opened FROM s JOIN ph USING (entry, phase)
""")
def phase_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of every phase of every series; its SQL finds the phases by a recursion over lists."""
    checks = stored(_record(spark, sf_dir), "record")
    rows = longview.phase_stats(checks, stored(history.phase_table(checks), "phases"))
    opened = F.array_join(F.transform("reasons", lambda r: F.concat_ws(" ", r.kind, r.old, r.new)), "; ")
    return rows.withColumn("opened", opened).drop("reasons", "from_at", "to_at")


@query(f"""
WITH RECURSIVE {_PHASES}, f AS (SELECT entry, top, arg_min(tag, pos) AS tag FROM c GROUP BY entry, top),
e AS (SELECT p.entry, p.pos, c.tag, CASE r.kind WHEN 'level' THEN 'level-shift' WHEN 'author' THEN 'top-change' WHEN 'share' THEN 'concentration' ELSE 'cadence' END AS kind,
        CASE r.kind WHEN 'level' THEN 'score level ' || CASE WHEN TRY_CAST(r.new AS BIGINT) > TRY_CAST(r.old AS BIGINT) THEN 'rose' ELSE 'fell' END || ': ' || r.old || ' → ' || r.new
          WHEN 'author' THEN 'top author changed: ' || r.old || ' → ' || r.new
          WHEN 'share' THEN 'commit concentration ' || CASE WHEN TRY_CAST(rtrim(r.new, '%') AS BIGINT) > TRY_CAST(rtrim(r.old, '%') AS BIGINT) THEN 'jumped' ELSE 'spread out' END || ': top identity ' || r.old || ' → ' || r.new
          ELSE 'release cadence changed: every ~' || r.old || ' days → ~' || r.new || ' days' END AS text
      FROM (SELECT entry, pos, unnest(reasons) AS r FROM ph) p JOIN c USING (entry, pos)
  UNION ALL SELECT entry, pos, tag, 'critical', critical || ' critical flag' || CASE WHEN critical > 1 THEN 's' ELSE '' END || ', scored ' || score || ' (' || label || ')' FROM c WHERE critical > 0
  UNION ALL SELECT entry, pos, tag, 'flagged', 'flagged at ' || score || ' (' || label || ')' FROM c WHERE flagged AND critical = 0
  UNION ALL SELECT entry, pos, tag, 'broken-promise', '1 promise from earlier notes broken' FROM c WHERE broken > 0
  UNION ALL SELECT c.entry, pos, c.tag, 'new-top-author', c.top || ', first seen in this release, authored ' || floor(share * 100 + 0.5)::BIGINT || '% of its commits'
      FROM c JOIN f ON f.entry = c.entry AND f.top = c.top AND f.tag = c.tag WHERE pos > 0 AND share >= 0.5),
q AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY list_position(['level-shift', 'top-change', 'concentration', 'cadence', 'critical', 'new-top-author', 'broken-promise', 'flagged'], kind), pos) AS best,
      count(*) OVER (PARTITION BY entry) AS found FROM e)
SELECT entry, pos, tag, kind, text, row_number() OVER (PARTITION BY entry ORDER BY pos, kind) AS place, found FROM q WHERE best <= 20
""")
def event_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of every series that its report shows, most telling first kept, in the record's order."""
    checks = stored(_record(spark, sf_dir), "record")
    first = checks.groupBy("entry", F.col("top").alias("name")).agg(F.min(F.struct("ord", "tag")).getField("tag").alias("first_tag"))
    found = longview.events(checks, stored(history.phase_table(checks), "phases"), first)
    return longview.selected_events(stored(found, "events")).drop("published_at")
