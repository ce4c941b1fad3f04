"""Manifest entries, flags and the carve-outs on worked examples."""

from noteproof.operators import flags, manifests, scoring
from pyspark.sql import functions as F

FILE = "release string, path string, status string, additions long, deletions long, patch string, coverage string"


def entries(spark, path, patch, **more):
    df = spark.createDataFrame([("r", path, patch)], "release string, path string, patch string")
    return {(r.sign, r.name, r.version) for r in manifests.dependency_entries(df, **more).collect()}


def new(spark, path, patch, repo=None):
    df = spark.createDataFrame([("r", path, patch, repo)], "release string, path string, patch string, repo string")
    return {r.name for r in manifests.new_dependencies(df).collect()}


def test_cargo_needs_its_section(spark):
    patch = """@@ -1,9 +1,9 @@
 [package]
+version = "0.2.0"
 [dependencies]
-serde = "1.0"
+serde = "1.1"
+anyhow.workspace = true
+tokio = { version = "1.2", features = ["x"] }
+[dev-dependencies.insta]
+version = "1.40"
+[dependencies.insta]
+version = "1.40"
@@ -30 +30 @@
+rand = "^0.8"
+edition = "2021"
"""
    assert entries(spark, "a/Cargo.toml", patch) == {("-", "serde", "1.0"), ("+", "serde", "1.1"), ("+", "tokio", "1.2"), ("+", "insta", None), ("+", "rand", "^0.8")}
    assert ("+", "insta", "1.40") in entries(spark, "a/Cargo.toml", patch, table_versions=True)
    assert new(spark, "a/Cargo.toml", patch) == {"tokio", "insta", "rand"}


def test_package_needs_its_block(spark):
    patch = """@@ -1,9 +1,9 @@
   "dependencies": {
-    "left-pad": "^1.0.0",
+    "left-pad": "^1.1.0",
+    "@x/y": "2.0.0"
   },
   "engines": {
+    "yarnx": ">=18"
   },
+  "other": "1.0"
@@ -40 +40 @@
+  "version": "3.0.0",
+  "stray": "3.0.0"
"""
    assert new(spark, "package.json", patch) == {"@x/y", "other", "stray"}
    assert new(spark, "package-lock.json", patch) == set()


def test_go_suppliers(spark):
    patch = """@@ -1,5 +1,9 @@
 require example.com/lego/v4 v4.0.0
-	sigs.k8s.io/gateway-api v1.0.0
+	sigs.k8s.io/gateway-api/conformance v1.0.0
+	example.com/lego/v5 v5.0.0
+	github.com/own/app/dynamic v0.0.1
+	evil.example/x v0.1.0
"""
    assert new(spark, "go.mod", patch, "host/own/app") == {"evil.example/x"}
    assert new(spark, "requirements.txt", "@@ -1 +1,2 @@\n-a==1\n+a==2\n+b>=1\n") == {"b"}


def test_lockfile_sources(spark):
    sha = "0123456789abcdef0123456789abcdef01234567"
    patch = f"@@ -1 +1,9 @@\n+ \"https://registry.npmjs.org/a.tgz\"\n+ \"https://evil.example/a.tgz\"\n+ source = \"git+https://h/r?rev=1#{sha}\"\n+ source = \"git+https://h/r\"\n+ registry+https://github.com/rust-lang/crates.io-index\n"
    df = spark.createDataFrame([("yarn.lock", patch), ("a.js", patch), ("go.sum", None)], "path string, patch string")
    got = [r[0] for r in df.select(manifests.lockfile_sources(F.col("path"), F.col("patch"))).collect()]
    assert got == [["https://evil.example/a.tgz", "git+https://h/r"], [], []]


def test_opacity(spark):
    rows = [
        ("a.png", "modified", None, 0, 0), ("a.so", "modified", None, 0, 0), ("a.rs", "modified", None, 0, 0), ("a.rs", "renamed", None, 0, 0), ("a.js", "modified", "@@\n+" + "x" * 801, 1, 0),
        ("a.py", "modified", "@@\n+" + "x" * 801, 1, 0), ("package.json", "modified", '@@\n+  "postinstall": "x"', 1, 0), ("package.json", "modified", '@@\n-  "postinstall": "x"', 0, 1),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, path string, status string, patch string, additions long, deletions long")
    got = [r[1] for r in df.select("k", manifests.opacity_issue(*[F.col(c) for c in ("path", "status", "patch", "additions", "deletions")])).orderBy("k").collect()]
    assert got == [None, "binary file", "no reviewable patch", None, "minified content", None, "install hook changed", None]


def test_silent_auth_change_is_critical_only_beside_full_notes(spark):
    files = spark.createDataFrame([(r, "src/auth.rs", "modified", 1, 0, "@@\n+x", "undocumented") for r in "abc"] + [("d", "src/auth.rs", "modified", 1, 0, "@@\n+x", "covered")], FILE)
    ratios = spark.createDataFrame([("a", 0.9), ("b", 0.2), ("c", None), ("d", 1.0)], "release string, ratio double")
    assert {(r.release, r.severity) for r in flags.file_flags(files, ratios).collect()} == {("a", "critical"), ("b", "warn"), ("c", "critical")}


def test_surplus(spark):
    df = spark.createDataFrame([("a", "1", "src/login.rs", True), ("a", "2", "src/x.rs", True), ("a", "3", "src/login.rs", False)], "release string, claim string, file string, notable boolean")
    assert {(r.subject, r.severity, r.n) for r in flags.surplus_flags(df).collect()} == {("1", "critical", 1), ("2", "warn", 1)}


CLAIM = "release string, kind string, verdict string, advisories array<string>, section string, generated boolean"


def test_unverifiable_shapes(spark):
    rows = [(r, "change", v, [], "Notes", False) for r in ("docs", "fork", "young", "bad") for v in ("no-evidence", "no-evidence", "no-evidence", "verified")]
    rows += [("cve", "change", "no-evidence", ["GHSA-x"], "Notes", False), ("bad", "change", "contradicted", [], "Notes", False), ("few", "change", "no-evidence", [], "Notes", False), ("few", "change", "verified", [], "Notes", False)]
    claims = spark.createDataFrame(rows, CLAIM)
    names = ("docs", "fork", "young", "bad", "cve", "few")
    files = spark.createDataFrame([(r, "README.md" if r == "docs" else "src/a.rs") for r in names], "release string, path string")
    base = spark.createDataFrame([(r, 2 if r == "young" else 5, 0.1) for r in names], "release string, snapshots int, lexical_coverage double")
    none = spark.createDataFrame([], "release string, severity string, kind string, subject string, n long")
    assert {(r.release, r["shape"]) for r in flags.unverifiable(files, claims, none, base).collect()} == {("docs", "sourceless"), ("fork", "out-of-repo")}
    shapes = flags.unverifiable(files, claims, none, base)
    told = flags.claim_flags(claims.withColumn("judge_failed", F.lit(False)))
    assert {(r.release, r.severity, r.kind) for r in flags.demoted(told, shapes).where("release in ('docs', 'bad')").collect()} == {
        ("docs", "info", "not-verifiable"), ("bad", "critical", "contradicted-claim"), ("bad", "warn", "unsupported-claim"),
    }
    churn = files.select("release", F.lit(10).alias("churn"), F.lit(True).alias("covered"), F.lit(True).alias("readable"))
    got = {r.release: (r.correctness, r.overall, r.label) for r in scoring.trust_scores(claims, churn, flags.demoted(told, shapes), "release", shapes).collect()}
    assert got["docs"] == (100, 65, "unverified")
    assert got["young"] == (25, 63, "questionable")


def test_skipped_and_meta_claims_weigh_nothing(spark):
    claims = spark.createDataFrame([("a", "change", "verified", [], "", False), ("a", "meta", "no-evidence", [], "", False), ("a", "change", "skipped", [], "", False)], CLAIM)
    files = spark.createDataFrame([("a", 10, True, True, False), ("a", 90, False, True, True)], "release string, churn long, covered boolean, readable boolean, merge boolean")
    none = spark.createDataFrame([], "release string, severity string")
    r = scoring.trust_scores(claims, files, none, "release").first()
    assert (r.correctness, r.completeness, r.overall, r.label) == (100, 100, 100, "solid")


def test_bump_marks(spark):
    releases = spark.createDataFrame([("a", "v1.2.3", "v1.2.4"), ("b", "v0.1.0", "v0.2.0"), ("c", "v1.2.3", "v1.3.0-rc.1")], "release string, base_ref string, head_ref string")
    commits = spark.createDataFrame([(r, s, b) for r in "abc" for s, b in (("fix!: x", ""), ("Merge y", "BREAKING CHANGE: z"), ("feat: w", None), ("free", "text"))], "release string, subject string, body string")
    assert {(r.release, r.kind, r.n) for r in flags.bump_flags(releases, commits).collect()} == {("a", "bump-mismatch", 1), ("a", "bump-mismatch-feat", 1)}
