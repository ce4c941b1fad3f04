"""Snapshots, baselines and costs on worked examples."""

from noteproof.operators import corpus


def test_snapshot_and_baseline(spark):
    releases = spark.createDataFrame([("r1",), ("r2",), ("none",)], "release string")
    claims = spark.createDataFrame(
        [("r1", 1, "change", "adds `load_it`", ["load_it"], [7], []), ("r1", 2, "change", "other_thing here", [], [], []), ("r1", 3, "meta", "thanks", [], [], ["2222222"])],
        "release string, claim long, kind string, text string, code_spans array<string>, pr_numbers array<long>, shas array<string>",
    )
    commits = spark.createDataFrame(
        [("r1", "1111111aa", "x", [7], "A@x.y ", "Ann", "ann"), ("r1", "2222222bb", "y", [], None, "Bob", None), ("r1", "3333333cc", "z", [], "a@x.y", "Ann", "ann"), ("r2", "4444444dd", "w", [], "a@x.y", "Ann", "ann2")],
        "release string, sha string, subject string, pr_numbers array<long>, email string, name string, login string",
    )
    files = spark.createDataFrame(
        [("r1", "src/auth.rs", "modified", 3, 1, "@@\n+load_it()"), ("r1", "a.so", "modified", 0, 0, None), ("r2", "go.mod", "modified", 1, 0, "@@\n+\tx.org/new v1.0.0")],
        "release string, path string, status string, additions long, deletions long, patch string",
    )
    got = {r.release: r for r in corpus.snapshots(releases, claims, commits, files).collect()}
    r = got["r1"]
    assert (r.commits, r.files, r.additions, r.deletions, r.claims, round(r.anchored_coverage, 4), r.lexical_coverage, r.sensitive, r.binaries, r.authors) == (3, 2, 3, 1, 3, 0.6667, 0.5, ["auth/crypto"], 1, ["Bob", "a@x.y"])
    assert got["r2"].new_deps == ["x.org/new"]
    assert (got["none"].commits, got["none"].anchored_coverage, got["none"].lexical_coverage) == (0, 1.0, 1.0)
    past = corpus.snapshots(releases, claims, commits, files).selectExpr("*", "'repo' as repo", "case release when 'r1' then 1 when 'r2' then 2 else 0 end as ord")
    b = corpus.baseline(past, "repo", "ord").first()
    assert (b.snapshots, b.median_churn, b.known_authors, [tuple(x) for x in b.email_accounts], b.ever_binary) == (3, 1.0, ["Bob", "a@x.y"], [("a@x.y", "ann2")], True)


def test_cost(spark):
    df = spark.createDataFrame([("r", 4_000_000, 10), ("r", 400, 5)], "release string, chars long, calls long")
    r = corpus.cost_estimate(df, concurrency=4).first()
    assert (r.calls, r.input_tokens, r.reserve, round(r.minutes, 6), round(r.dollars, 6)) == (15, 1_000_100, 8, round(19 * 10 / 4 / 60, 6), round(1.0001 + 0.0225, 6))
