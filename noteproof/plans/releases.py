"""Queries on whole releases: the version's claim, new dependencies, risk flags, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapt
from ..functions import text as T
from ..operators import corpus, flags, manifests, scoring, substance
from ..operators import pin_moves as moves
from ..registry import query
from .sql import SHAPES, SHAPES_SQL, matches_sql, sensitive_sql

SUBJECTS = ["feat(x): a thing", "fix!: b", "chore: c", "Merge pull request", "free words", "refactor: d", "Note: e", "feat!: f", "docs: g", "plain"]
_SUBJECTS_SQL = "[" + ", ".join(f"'{x}'" for x in SUBJECTS) + "]"
_HEX = "0123456789abcdef0123456789abcdef01234567"
HOSTS = ["https://registry.npmjs.org/a.tgz", "https://evil.example/a.tgz", f"git+https://git.example/r#{_HEX}", "git+ssh://git.example/r", "registry+https://github.com/rust-lang/crates.io-index"]
_HOSTS_SQL = "[" + ", ".join(f"'{x}'" for x in HOSTS) + "]"

_BUMPS = f"""
rel AS (SELECT c_custkey AS release, CASE WHEN c_custkey % 9 = 0 THEN 'app-' ELSE 'v' END AS prefix, c_custkey % 2 AS major, c_custkey % 3 AS minor, c_custkey % 4 AS patch, c_custkey % 5 AS step FROM customer),
tag AS (SELECT release, major, CASE step WHEN 0 THEN 'patch' WHEN 1 THEN 'patch' WHEN 2 THEN 'minor' WHEN 3 THEN 'major' ELSE 'pre' END AS bump FROM rel),
com AS (SELECT o_custkey AS release, ({_SUBJECTS_SQL})[1 + o_orderkey % {len(SUBJECTS)}] AS subject, CASE WHEN o_orderkey % 11 = 0 THEN 'x' || chr(10) || 'BREAKING CHANGE: y' ELSE 'text BREAKING CHANGE: z' END AS body FROM orders),
own AS (SELECT release, subject, regexp_matches(subject, '^[A-Za-z]+(\\([^)]*\\))?!:\\s') OR regexp_matches(body, '(?m)^BREAKING[ -]CHANGE:') AS breaking FROM com WHERE NOT starts_with(subject, 'Merge ')),
told AS (SELECT release, count(*) FILTER (breaking) AS breaking, count(*) FILTER (regexp_matches(subject, '{flags.CONVENTIONAL}')) AS conventional, count(*) FILTER (regexp_matches(subject, '{flags.FEATURE}') AND NOT breaking) AS features, count(*) AS own FROM own GROUP BY release)
"""


def _releases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    prefix = F.when(k % 9 == 0, "app-").otherwise("v")
    major, minor, patch = k % 2, k % 3, k % 4
    dotted = lambda *parts: F.concat(prefix, F.concat_ws(".", *[p.cast("string") for p in parts]))
    head = (
        F.when(k % 5 < 2, dotted(major, minor, patch + 1)).when(k % 5 == 2, dotted(major, minor + 1, F.lit(0)))
        .when(k % 5 == 3, dotted(major + 1, F.lit(0), F.lit(0))).otherwise(F.concat(dotted(major, minor, patch + 1), F.lit("-rc.1")))
    )
    releases = adapt.table(spark, sf_dir, "customer").select(k.alias("release"), dotted(major, minor, patch).alias("base_ref"), head.alias("head_ref"))
    subject = F.get(F.array(*[F.lit(x) for x in SUBJECTS]), (F.col("o_orderkey") % len(SUBJECTS)).cast("int"))
    body = F.when(F.col("o_orderkey") % 11 == 0, "x\nBREAKING CHANGE: y").otherwise("text BREAKING CHANGE: z")
    return releases, adapt.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("release"), subject.alias("subject"), body.alias("body"))


@query(f"""
WITH {_BUMPS}
SELECT release, 'warn' AS severity, 'bump-mismatch' AS kind, bump AS subject, breaking AS n FROM tag JOIN told USING (release) WHERE breaking > 0 AND (bump = 'patch' OR (bump = 'minor' AND major >= 1))
UNION ALL SELECT release, 'info', 'bump-mismatch-feat', bump, features FROM tag JOIN told USING (release) WHERE bump = 'patch' AND features > 0 AND 4 * conventional >= own
""")
def bump_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version numbers held against the commits' own marks."""
    return flags.bump_flags(*_releases(spark, sf_dir))


_ENTRIES = """
e AS (SELECT DISTINCT l_suppkey AS release, CASE l_returnflag WHEN 'R' THEN '-' WHEN 'A' THEN ' ' ELSE '+' END AS sign,
      'ex.org/m' || (l_partkey % 300) || CASE WHEN l_orderkey % 3 = 0 THEN '/v2' WHEN l_orderkey % 5 = 0 THEN '/sub' ELSE '' END AS name FROM lineitem),
r AS (SELECT *, regexp_replace(name, '/v[0-9]+$', '') AS root FROM e)
"""


@query(f"""
WITH {_ENTRIES}
SELECT DISTINCT a.release, 'go.mod' AS path, a.name FROM r a WHERE sign = '+' AND NOT EXISTS (SELECT 1 FROM r k WHERE k.release = a.release AND k.sign <> '+'
  AND (k.name = a.name OR k.root = a.root OR starts_with(a.root, k.root || '/') OR starts_with(k.root, a.root || '/')))
""")
def new_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies that the diffs of manifests add, one manifest a supplier."""
    sign = F.when(F.col("l_returnflag") == "R", "-").when(F.col("l_returnflag") == "A", " ").otherwise("+")
    tail = F.when(F.col("l_orderkey") % 3 == 0, "/v2").when(F.col("l_orderkey") % 5 == 0, "/sub").otherwise("")
    line = F.concat(sign, F.lit("\tex.org/m"), (F.col("l_partkey") % 300).cast("string"), tail, F.lit(" v1."), (F.col("l_partkey") % 7).cast("string"))
    patch = F.concat(F.lit("@@ -1 +1 @@\n"), F.array_join(F.collect_list("line"), "\n")).alias("patch")
    files = adapt.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("release"), line.alias("line")).groupBy("release").agg(patch)
    return manifests.new_dependencies(files.select("release", F.lit("go.mod").alias("path"), "patch"))


_RELEASE_TABLES = f"""
f AS (SELECT l_suppkey AS release, 'm' || l_orderkey || '/' || ({SHAPES_SQL})[1 + l_partkey % {len(SHAPES)}] AS path, CASE WHEN l_linestatus = 'O' THEN 'modified' ELSE 'renamed' END AS status, l_linenumber AS line,
      CASE WHEN l_discount < 0.03 THEN 'undocumented' WHEN l_discount < 0.06 THEN 'covered' WHEN l_discount < 0.08 THEN 'evidence' ELSE 'unknown' END AS coverage,
      l_quantity::BIGINT % 7 = 0 AS bare, CASE WHEN l_quantity::BIGINT % 14 = 0 THEN 0 ELSE l_quantity::BIGINT END AS additions, ({_HOSTS_SQL})[1 + l_orderkey % {len(HOSTS)}] AS host, l_tax > 0.04 AS install FROM lineitem),
s AS (SELECT *, {sensitive_sql("path")} AS category, NOT bare AND {matches_sql("path", manifests.LOCKFILE)} AND (contains(host, 'evil') OR contains(host, 'git+ssh')) AS source,
      CASE WHEN {matches_sql("path", T.BENIGN_BINARY)} THEN FALSE WHEN {matches_sql("path", T.OPAQUE_BINARY)} THEN TRUE WHEN bare AND status <> 'renamed' AND additions = 0 THEN TRUE
      ELSE NOT bare AND install AND regexp_matches(path, 'package\\.json$') END AS opaque FROM f),
c AS (SELECT l_suppkey AS release, CASE WHEN l_linestatus = 'F' AND l_tax > 0.05 THEN 'meta' ELSE 'change' END AS kind, l_tax > 0.07 AS judge_failed, l_quantity > 25 AS generated,
      CASE WHEN l_returnflag = 'R' AND l_suppkey % 3 = 0 AND l_discount > 0.09 THEN 'contradicted' WHEN l_returnflag = 'R' THEN 'no-evidence' WHEN l_discount > 0.08 THEN 'skipped' WHEN l_returnflag = 'A' THEN 'partial' ELSE 'verified' END AS verdict FROM lineitem),
ratio AS (SELECT s_suppkey AS release, CASE WHEN s_suppkey % 4 > 0 THEN (s_suppkey % 11) / 10.0::DOUBLE END AS ratio FROM supplier),
told AS (SELECT release, count(*) FILTER (verdict = 'contradicted') AS contradicted, count(*) FILTER (judge_failed) AS unjudged, count(*) FILTER (verdict = 'no-evidence' AND kind = 'change') AS unsupported FROM c GROUP BY release),
k AS (SELECT release, category, count(*) AS n FROM s WHERE coverage = 'undocumented' AND category IS NOT NULL GROUP BY release, category),
flag AS (
  SELECT release, 'critical' AS severity, 'contradicted-claim' AS kind, contradicted AS n FROM told WHERE contradicted > 0 UNION ALL SELECT release, 'warn', 'judge-unavailable', unjudged FROM told WHERE unjudged > 0
  UNION ALL SELECT release, 'warn', 'unsupported-claim', unsupported FROM told WHERE unsupported > 0
  UNION ALL SELECT release, CASE WHEN category = 'auth/crypto' AND (ratio IS NULL OR ratio >= 0.6) THEN 'critical' ELSE 'warn' END, 'undocumented-sensitive', n FROM k JOIN ratio USING (release)
  UNION ALL SELECT release, CASE WHEN coverage = 'undocumented' THEN 'critical' ELSE 'warn' END, 'lockfile-source', 1 FROM s WHERE source
  UNION ALL SELECT release, CASE WHEN coverage IN ('evidence', 'covered') THEN 'warn' ELSE 'critical' END, 'opaque-change', 1 FROM s WHERE opaque)
"""


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """claims, files, ratios of releases, one per supplier."""
    line = adapt.table(spark, sf_dir, "lineitem")
    release, quantity, discount = F.col("l_suppkey").alias("release"), F.col("l_quantity").cast("long"), F.col("l_discount")
    shape = F.get(F.array(*[F.lit(x) for x in SHAPES]), (F.col("l_partkey") % len(SHAPES)).cast("int"))
    host = F.get(F.array(*[F.lit(x) for x in HOSTS]), (F.col("l_orderkey") % len(HOSTS)).cast("int"))
    hook = F.when(F.col("l_tax") > 0.04, F.lit('\n+  "postinstall": "x"')).otherwise("")
    coverage = F.when(discount < 0.03, "undocumented").when(discount < 0.06, "covered").when(discount < 0.08, "evidence").otherwise("unknown")
    files = line.select(
        release, F.concat(F.lit("m"), F.col("l_orderkey").cast("string"), F.lit("/"), shape).alias("path"), F.when(F.col("l_linestatus") == "O", "modified").otherwise("renamed").alias("status"),
        F.when(quantity % 14 == 0, 0).otherwise(quantity).alias("additions"), F.lit(0).alias("deletions"), coverage.alias("coverage"),
        F.when(quantity % 7 != 0, F.concat(F.lit('@@ -1 +1 @@\n+resolved "'), host, F.lit('"'), hook)).alias("patch"),
    )
    flag = F.col("l_returnflag")
    verdict = (
        F.when((flag == "R") & (F.col("l_suppkey") % 3 == 0) & (discount > 0.09), "contradicted").when(flag == "R", "no-evidence").when(discount > 0.08, "skipped")
        .when(flag == "A", "partial").otherwise("verified")
    )
    kind = F.when((F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.05), "meta").otherwise("change")
    claims = line.select(release, kind.alias("kind"), (F.col("l_tax") > 0.07).alias("judge_failed"), (F.col("l_quantity") > 25).alias("generated"), verdict.alias("verdict"))
    ratios = adapt.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("release"), F.when(F.col("s_suppkey") % 4 > 0, (F.col("s_suppkey") % 11) / 10.0).alias("ratio"))
    return claims, files, ratios


@query(f"WITH {_RELEASE_TABLES} SELECT release, severity, kind, count(*) AS flags, sum(n)::BIGINT AS n FROM flag GROUP BY ALL")
def release_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of claims and files, by severity and kind."""
    claims, files, ratios = _tables(spark, sf_dir)
    found = flags.claim_flags(claims).unionByName(flags.file_flags(files, ratios))
    return found.groupBy("release", "severity", "kind").agg(F.count(F.lit(1)).alias("flags"), F.sum("n").alias("n"))


@query(f"""
WITH {_RELEASE_TABLES}, g AS (SELECT release, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warn' AND NOT (kind = 'unsupported-claim' AND release % 5 = 0 AND release NOT IN (SELECT release FROM flag WHERE severity = 'critical'))) AS warn FROM flag GROUP BY release),
x AS (SELECT release, release % 5 = 0 AND release NOT IN (SELECT release FROM flag WHERE severity = 'critical') AS excused FROM told),
w AS (SELECT release, max((verdict = 'contradicted')::INT) AS contradicted, count(*) FILTER (verdict = 'no-evidence' AND kind = 'change' AND excused) AS dropped,
      sum(CASE WHEN verdict = 'skipped' OR kind <> 'change' OR (excused AND verdict = 'no-evidence') THEN 0 WHEN generated THEN 0.25 ELSE 1 END)::DOUBLE AS weight,
      sum(CASE WHEN kind <> 'change' THEN 0 WHEN generated THEN 0.25 ELSE 1 END * CASE verdict WHEN 'verified' THEN 1 WHEN 'partial' THEN 0.5 ELSE 0 END)::DOUBLE AS points FROM c JOIN x USING (release) GROUP BY release),
m AS (SELECT release, CASE WHEN weight > 0 THEN round(100 * points / weight) ELSE 100 END AS correctness, greatest(0, 100 - 25 * coalesce(critical, 0) - 10 * coalesce(warn, 0)) AS risk, contradicted, coalesce(critical, 0) AS critical, dropped FROM w LEFT JOIN g USING (release)),
o AS (SELECT *, round(0.6 * correctness + 0.4 * risk) AS blend FROM m), p AS (SELECT *, CASE WHEN contradicted = 1 THEN least(blend, 35) WHEN critical > 0 THEN least(blend, 45) ELSE blend END AS capped FROM o),
q AS (SELECT *, CASE WHEN dropped > 0 THEN least(capped, 65) ELSE capped END AS overall FROM p)
SELECT release, correctness::BIGINT AS correctness, risk::BIGINT AS risk, overall::BIGINT AS overall,
       CASE WHEN dropped > 0 THEN 'unverified' WHEN overall >= 85 THEN 'solid' WHEN overall >= 65 THEN 'minor gaps' WHEN overall >= 45 THEN 'questionable' ELSE 'suspicious' END AS label FROM q
""")
def check_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From claims and files to flags, the carve-out of releases that nobody could check, and scores.

    Every fifth release stands for one whose history shows notes about code elsewhere, its diff unreadable."""
    claims, files, ratios = _tables(spark, sf_dir)
    found = flags.claim_flags(claims).unionByName(flags.file_flags(files, ratios))
    critical = found.where("severity = 'critical'").select("release").distinct()
    shapes = claims.where("release % 5 = 0").select("release").distinct().join(critical, "release", "left_anti").select("release", F.lit("out-of-repo").alias("shape"))
    churn = files.select("release", F.lit(0).alias("churn"), F.lit(False).alias("covered"), F.lit(False).alias("readable"))
    scores = scoring.trust_scores(claims, churn, flags.demoted(found, shapes), "release", shapes)
    return scores.select("release", "correctness", "risk", "overall", "label")


_IDIOMS = [
    'x := os.Getenv("VAR_#")', "process.env.VAR_#", "process.env['VAR_#']", 'env::var("VAR_#")', "os.environ['VAR_#']", "os.getenv('VAR_#')", "ENV.fetch('VAR_#')", 'A string `env:"VAR_#;OTHER_#"`', "no VAR_# read", "getenv(VAR_#)",
]
_IDIOMS_SQL = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in _IDIOMS) + "]"
_READS_SQL = "list_concat(" * (len(substance.ENV_GROUPS) - 1) + "".join(
    ("" if k == 0 else ", ") + "regexp_extract_all(line, '" + p.replace("'", "''") + f"', {g})" + ("" if k == 0 else ")") for k, (p, g) in enumerate(substance.ENV_GROUPS)
)


@query(f"""
WITH l AS (SELECT l_suppkey AS release, l_returnflag <> 'R' AS plus, replace(({_IDIOMS_SQL})[1 + l_orderkey % {len(_IDIOMS)}], '#', (l_partkey % 400)::VARCHAR) AS line FROM lineitem),
n AS (SELECT DISTINCT release, plus, unnest(flatten(list_transform({_READS_SQL}, lambda x: string_split(replace(x, ',', ';'), ';')))) AS name FROM l), s AS (SELECT release, name, count(*) AS n, bool_or(plus) AS plus FROM n WHERE name <> '' GROUP BY ALL)
SELECT release, 'envVars' AS layer, name, plus FROM s WHERE n = 1
""")
def env_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Environment variables that only one side of a release's diff reads."""
    idiom = F.get(F.array(*[F.lit(x) for x in _IDIOMS]), (F.col("l_orderkey") % len(_IDIOMS)).cast("int"))
    line = F.concat(F.when(F.col("l_returnflag") == "R", "-").otherwise("+"), F.replace(idiom, F.lit("#"), (F.col("l_partkey") % 400).cast("string")))
    lines = adapt.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("release"), (F.col("l_orderkey") % 7).alias("file"), line.alias("line"))
    files = lines.groupBy("release", "file").agg(F.concat(F.lit("@@ -1 +1 @@\n"), F.array_join(F.collect_list("line"), "\n")).alias("patch"))
    delta = substance.surface_delta(files.select("release", F.concat(F.lit("src/f"), F.col("file").cast("string"), F.lit(".rs")).alias("path"), "patch"))
    return delta.select("release", "layer", "name", "plus")


@query("""
WITH l AS (SELECT l_suppkey AS release, l_returnflag = 'R' AS old, 'M' || (l_partkey % 30) || CASE WHEN l_partkey % 5 = 0 THEN '_SIZE' ELSE '_VERSION' END AS name, '1.' || (l_quantity::BIGINT % 9) AS version, row(l_orderkey, l_linenumber, l_partkey, l_quantity) AS ord FROM lineitem),
e AS (SELECT * FROM l WHERE name LIKE '%VERSION'), o AS (SELECT release, name, arg_max(version, ord) AS "from" FROM e WHERE old GROUP BY ALL)
SELECT release, name, "from", arg_min(version, ord) AS "to" FROM e JOIN o USING (release, name) WHERE NOT old AND version <> "from" GROUP BY ALL
""")
def pin_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins that the changed lines of makefiles move, one file a supplier."""
    named = F.concat(F.lit("M"), (F.col("l_partkey") % 30).cast("string"), F.when(F.col("l_partkey") % 5 == 0, "_SIZE").otherwise("_VERSION"))
    line = F.concat(F.when(F.col("l_returnflag") == "R", "-").otherwise("+"), named, F.lit(" := 1."), (F.col("l_quantity").cast("long") % 9).cast("string"))
    place = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", line.alias("line"))
    files = adapt.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("release")).agg(F.array_sort(F.collect_list(place)).alias("lines"))
    patch = F.concat(F.lit("@@ -1 +1 @@\n"), F.array_join(F.col("lines.line"), "\n")).alias("patch")
    return moves.pin_moves(files.select("release", F.lit("Makefile").alias("path"), patch)).select("release", "name", "from", "to")


_TEXTS = ["bump `a/b` from 1.0 to 1.1", "Update dependency x-y to v2.0", "faster start", "update the docs to 3 sections", "drop old code"]
_TEXTS_SQL = "[" + ", ".join(f"'{x}'" for x in _TEXTS) + "]"
_METHODS = [["pr-anchor", "lexical"], ["sha-anchor"], ["lexical", "escalated"], [], ["pin-anchor", "escalated"], ["escalated"]]
_METHODS_SQL = "[" + ", ".join("[" + ", ".join(f"'{m}'" for m in x) + "]::VARCHAR[]" for x in _METHODS) + "]"


@query(f"""
WITH r AS (SELECT l_suppkey % 25 AS repo, l_tax > 0.07 AS meta, ({_TEXTS_SQL})[1 + l_partkey % {len(_TEXTS)}] AS text, l_quantity > 40 AS generated, ({_METHODS_SQL})[1 + l_orderkey % {len(_METHODS)}] AS methods,
  l_discount > 0.03 AS judged, l_discount BETWEEN 0.025 AND 0.035 AS judge_failed, CASE WHEN l_linenumber % 4 = 0 THEN ['a', 'a', CASE WHEN l_orderkey % 2 = 0 THEN 'a' ELSE 'b' END]::VARCHAR[] ELSE []::VARCHAR[] END AS votes, l_returnflag = 'R' AS surplus FROM lineitem),
c AS (SELECT repo, judged, judge_failed, votes, CASE WHEN meta THEN 'meta' WHEN regexp_matches(text, '^(bump|Update dependency)') THEN 'bump' WHEN generated THEN 'generated'
  WHEN list_has_any(methods, ['pr-anchor', 'sha-anchor', 'pin-anchor']) THEN CASE WHEN list_contains(methods, 'lexical') THEN 'anchored-strong' ELSE 'anchored-weak' END WHEN list_contains(methods, 'lexical') THEN 'unanchored-lexical' ELSE 'unanchored-none' END AS class,
  CASE WHEN judged OR judge_failed THEN CASE WHEN len(votes) > 0 THEN len(votes) WHEN list_contains(methods, 'escalated') THEN 2 ELSE 1 END + surplus::INT ELSE 0 END AS calls FROM r)
SELECT repo, class, count(*) AS claims, count(*) FILTER (judged) AS judged, count(*) FILTER (judge_failed) AS failed, sum(calls)::BIGINT AS calls, count(*) FILTER (len(votes) > 0) AS second_look, count(*) FILTER (len(list_distinct(votes)) > 1) AS split FROM c GROUP BY repo, class
""")
def judge_bill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each class of claims cost a judge, per repository."""
    pick = lambda xs, key: F.get(F.array(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(m) for m in x]).cast("array<string>") for x in xs]), (F.col(key) % len(xs)).cast("int"))
    votes = F.when(F.col("l_linenumber") % 4 == 0, F.array(F.lit("a"), F.lit("a"), F.when(F.col("l_orderkey") % 2 == 0, "a").otherwise("b")))
    results = adapt.table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 25).alias("repo"), F.when(F.col("l_tax") > 0.07, "meta").otherwise("change").alias("kind"), pick(_TEXTS, "l_partkey").alias("text"), (F.col("l_quantity") > 40).alias("generated"),
        pick(_METHODS, "l_orderkey").alias("methods"), (F.col("l_discount") > 0.03).alias("judged"), F.col("l_discount").between(0.025, 0.035).alias("judge_failed"), votes.alias("votes"), (F.col("l_returnflag") == "R").alias("surplus"),
    )
    return corpus.judge_bill(results, "repo")


_CHECKS_SQL = "c AS (SELECT user_id AS entry, event_id AS tag, ts AS published, least(100, floor(value))::BIGINT AS score FROM events)"


@query(f"""
WITH {_CHECKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY published DESC, tag DESC) AS age FROM c)
SELECT CASE WHEN score >= 85 THEN 'solid' WHEN score >= 65 THEN 'minor gaps' WHEN score >= 45 THEN 'questionable' ELSE 'suspicious' END AS label, count(*) AS entries FROM r WHERE age = 1 GROUP BY 1
""")
def latest_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every entry's latest check."""
    return corpus.latest_labels(adapt.checks(spark, sf_dir), "published_at", "tag")


@query(f"""
WITH {_CHECKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY published DESC, tag DESC) AS age FROM c),
s AS (SELECT entry, list(score ORDER BY age DESC) AS scores FROM r WHERE age <= 6 GROUP BY entry)
SELECT entry, scores, list_transform(scores, lambda x: round((x - list_min(scores)) / CASE WHEN list_max(scores) > list_min(scores) THEN list_max(scores) - list_min(scores) ELSE 1 END::DOUBLE, 6)) AS places FROM s
""")
def score_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six scores of every entry, and their places between the least and the most."""
    return corpus.trends(adapt.checks(spark, sf_dir), "published_at", "tag")
