"""Budgets, fronts, histories, stored reports and counterfactual coverage on worked cases."""

import itertools

import numpy as np
from noteproof.operators import cache, coverage, findings, lineage, skyline
from pyspark.sql import functions as F


def test_budget_goes_top_down(spark):
    files = [("r", f"m{k}/a.py", 2**k, 0, "@@") for k in range(6)] + [("r", "CHANGELOG.md", 9000, 0, "@@"), ("r", "m9/b.py", 9000, 0, None)]
    df = spark.createDataFrame(files, "release string, path string, additions long, deletions long, patch string")
    got = {r.subsystem: (r.place, r.alloc) for r in findings.plan_findings(df, 47_000).collect()}
    assert got == {"m5": (1, 20_000), "m4": (2, 20_000), "m3": (3, 7_000), "m2": (4, 0), "m1": (5, 0), "m0": (6, 0)}
    small = {r.subsystem: r.alloc for r in findings.plan_findings(df, 43_000).collect()}
    assert small["m3"] == 0


def test_cut_texts_count_their_mark(spark):
    df = spark.createDataFrame([(["abcd", "efgh", "ij"],), ([],), (["abcdefghijkl", "x"],), (["abcde", "fghij", "k"],)], "t array<string>")
    got = [r[0] for r in df.select(findings.cut_texts(F.col("t"), 10)).collect()]
    assert got == [["abcd", "efgh", "ij"], [], ["abcdefghij… [truncated]"], ["abcde", "fghij"]]


def test_front_on_four_axes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    points = rng.integers(0, 6, (400, 4)).astype(float)
    points[:40] = points[40:80]
    sphere = rng.normal(size=(150, 4))
    sphere = np.abs(sphere / np.linalg.norm(sphere, axis=1, keepdims=True)).round(3)
    monkeypatch.setattr(skyline, "BLOCK", 16)
    for values in (points, sphere, points[:1]):
        rows = spark.createDataFrame([tuple(map(float, p)) for p in values] + [(None, 9.0, 9.0, 9.0)], "a double, b double, c double, d double").repartition(3)
        got = {tuple(r) for r in skyline.pareto(rows, ["a", "b", "c", "d"]).collect()}
        assert got == {tuple(p) for p in values if not any((q >= p).all() and (q > p).any() for q in values)}


def test_roots_within_a_walk(spark):
    chain = [(k, k - 1 if k else None) for k in range(12)] + [(100, None), (201, 200)]
    df = spark.createDataFrame(chain, "sha long, parent long")
    got = {r.sha: r.root for r in lineage.roots(df, walk=5).collect()}
    assert got == {k: 0 if 1 <= k <= 4 else None for k in range(12)} | {100: None, 201: None}


def test_releases_that_a_changelog_proves(spark):
    text = "# Log\n\n## v2.0.0\nnew\n\n```\n## 1.1.0\n```\n\n## 1.0.0 (2024)\nold\n### Fixed\nmore\n## 0.9.0\n"
    logs = spark.createDataFrame([("r", text), ("s", None)], "repo string, text string")
    tags = [("r", t, k) for k, t in enumerate(["v0.9.0", "v1.0.0", "v1.1.0", "v2.0.0-rc.1", "v2.0.0"])] + [("s", "v1.0.0", 1)]
    df = spark.createDataFrame(tags, "repo string, tag string, tagged_at long")
    got = {r.tag: r.notes for r in lineage.provable_releases(logs, df).collect()}
    assert got == {"v2.0.0": "new\n\n```\n## 1.1.0\n```", "v1.0.0": "old\n### Fixed\nmore", "v0.9.0": ""}
    assert {r.tag for r in lineage.provable_releases(logs, df, scan=2).collect()} == {"v2.0.0"}


def test_reports_compared(spark):
    kept = spark.createDataFrame([("a", ["x", "y"], None), ("b", ["z"], ["q"])], "k string, added array<string>, removed array<string>")
    new = spark.createDataFrame([("a", ["y", "w"], []), ("c", [], ["q"])], "k string, added array<string>, removed array<string>")
    got = {r.k: tuple(r)[1:] for r in lineage.compare_reports(kept, new, ["k"], ["added", "removed"]).collect()}
    assert got == {"a": ("both", True, ["x"], ["w"], [], []), "b": ("stored", True, ["z"], [], ["q"], []), "c": ("rebuilt", True, [], [], [], ["q"])}


def test_lost_without_equals_leaving_one_out(spark):
    rng = np.random.default_rng(2)
    names = ["1 anchor", "2 evidence", "3 pin", "4 breadth", "5 depth"]
    rows = sorted({("r", f"s{a}", names[b], int(c)) for a, b, c in zip(rng.integers(0, 30, 60), rng.integers(0, 5, 60), rng.integers(0, 8, 60), strict=True)})
    found = spark.createDataFrame(rows, "release string, sha string, route string, claim long")
    covered = lambda held: {s for _, s, _, _ in held}
    want = {c: n for c in range(8) if (n := len(covered(rows)) - len(covered([r for r in rows if r[3] != c])))}
    assert {r.claim: r.lost for r in coverage.lost_without(found).collect()} == want
    commits = spark.createDataFrame([("r", f"s{k}", "Merge branch 'x'" if k == 3 else "one") for k in range(31)], "release string, sha string, subject string")
    for r in coverage.diagnosis(found, commits).collect():
        own = [x for x in rows if x[1] == r.sha]
        assert r.claims == len({x[3] for x in own})
        assert r.only_claim == (own[0][3] if r.claims == 1 else None)
        assert r.breadth_alone == ({x[2] for x in own} == {"4 breadth"} and r.sha != "s3")
        assert [r.anchor, r.evidence, r.pin, r.breadth, r.depth] == [n in {x[2] for x in own} for n in names]


def test_bucket_rates(spark):
    df = spark.createDataFrame(list(itertools.product("ab", range(4))), "bucket string, n long")
    got = {r.bucket: (r.n, r.fired, r.rate) for r in coverage.bucket_rates(df, F.col("bucket"), (F.col("bucket") == "a") & (F.col("n") < 1)).collect()}
    assert got == {"a": (4, 1, 0.25), "b": (4, 0, 0.0)}


def test_cache_computes_misses_once(spark, tmp_path):
    path, calls = f"file://{tmp_path}/c", []

    def compute(misses):
        calls.append(sorted(r.key for r in misses.collect()))
        return misses.select("key", F.concat(F.lit("a"), "key").alias("value"))

    ask = lambda *keys: spark.createDataFrame([(k,) for k in keys], "key string")
    rows, _ = cache.answered(ask("x", "y", "x"), path, "v/1", "one", compute)
    assert sorted(map(tuple, rows.collect())) == [("x", "ax", False), ("x", "ax", False), ("y", "ay", False)]
    rows, _ = cache.answered(ask("y", "z"), path, "v/1", "two", compute)
    assert sorted(map(tuple, rows.collect())) == [("y", "ay", True), ("z", "az", False)]
    rows, _ = cache.answered(ask("y"), path, "v/2", "three", compute)
    assert [tuple(r) for r in rows.collect()] == [("y", "ay", False)]
    assert calls == [["x", "y"], ["z"], ["y"]]
    assert sorted(map(tuple, cache.histogram(cache.read(spark, path)).collect())) == [("v-1", 3, 3, 6), ("v-2", 1, 1, 2)]
    assert cache.collect_versions(spark, path, "v/2") == ["v-1"]
    assert [r.key for r in cache.read(spark, path).collect()] == ["y"]
    # a run told again takes its own place
    cache.keep(ask("y").withColumn("value", F.lit("b")), path, "v/2", "three")
    assert [(r.key, r.value) for r in cache.read(spark, path).collect()] == [("y", "b")]


def test_cache_of_a_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(f"k{k}", "v"), ("k0", f"w{k}")], "key string, value string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("key string, value string").parquet(f"{tmp_path}/in")
        cache.stream_into(stream, f"file://{tmp_path}/c", "1", f"{tmp_path}/cp")
    held = cache.read(spark, f"file://{tmp_path}/c")
    assert sorted((r.run, r.key) for r in held.collect()) == [("batch-0", "k0"), ("batch-0", "k0"), ("batch-1", "k0"), ("batch-1", "k1"), ("batch-2", "k0"), ("batch-2", "k2")]
    assert cache.histogram(held).first().answers == 3


def test_fingerprints_tell_nulls_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("", "a"), ("null", "a"), ("a", None), ("a", "a")], "x string, y string")
    assert df.select(cache.fingerprint("y", "x").alias("k")).distinct().count() == 5
    assert df.select((cache.fingerprint("x", "y") == cache.fingerprint("y", "x")).alias("e")).where("e").count() == 5
