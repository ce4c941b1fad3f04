"""The watch state on worked examples, and the stream against its batch twin."""

import datetime as dt
import random

from noteproof.streaming import ledger, ledgers, watch
from pyspark.sql import functions as F


def row(tag, at, run, score=90, **more):
    return {"tag": tag, "at": at, "run": run, "score": score, "exit_code": 0, "critical": 0, "unjudged": 0, "rule_hits": 0} | more


def test_cursor_moves_forward_and_tags_are_kept_once():
    state, out = watch.fold(None, [row("b", 20, 1), row("a", 10, 2), row("b", 20, 3, 50)])
    assert (state["cursor"], state["cursor_tag"]) == (20, "b")
    assert [(h["tag"], h["score"]) for h in state["history"]] == [("a", 90), ("b", 50)]
    assert [d[2] for d in out] == ["checked"] * 3
    state, _ = watch.fold(state, [row(f"t{k}", 30 + k, 10 + k) for k in range(30)])
    assert len(state["history"]) == watch.HISTORY_LIMIT


def test_third_failure_gives_up_and_success_resets():
    state, out = watch.fold(None, [row("x", 5, k, None) for k in (1, 2)] + [row("y", 4, 3)] + [row("x", 5, k, None) for k in (4, 5, 6)])
    assert [d[2] for d in out] == ["retry", "retry", "checked", "retry", "retry", "skip"]
    assert (state["skipped"], state["cursor"], state["failing"]) == (["x"], 5, None)
    _, out = watch.fold(None, [row("x", 5, 1, None), row("x", 5, 2, None), row("z", 5, 3, None), row("x", 5, 4, None)])
    assert [d[2] for d in out] == ["retry"] * 4


def test_reasons_to_alert():
    flagged = lambda rows: watch.fold(None, rows)[1][-1][6]
    assert flagged([row("a", 1, 1, 64)])
    assert not flagged([row("a", 1, 1, 65)])
    low = [row(str(k), k, k, 25) for k in range(5)]
    assert not flagged([*low, row("x", 9, 9, 6)])  # a level of one's own replaces the absolute bar
    assert flagged([*low, row("x", 9, 9, 5)])
    assert flagged([row("a", 1, 1, 90, critical=1)])
    assert flagged([row("a", 1, 1, 90, exit_code=1)])
    assert flagged([row("a", 1, 1, 90, rule_hits=1)])
    assert flagged([row(str(k), k, k, 90, unjudged=1) for k in range(3)])
    assert not flagged([row(str(k), k, k, 90, unjudged=1) for k in range(2)])
    assert flagged([row(str(k), k, k, s) for k, s in enumerate([90, 88, 80, 72, 64, 56])])


def test_late_releases_meet_their_own_past():
    rows = [row(str(k), 10 * k, k, 90) for k in range(5, 10)] + [row("old", 1, 20, 70)]
    assert watch.fold(None, rows)[1][-1][3:] == (None, False, 0, False)


def test_stream_equals_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    data = [
        (e, f"t{(k * 5) % 17}", base + dt.timedelta(days=(k * 5) % 17), k, None if k % 7 == 6 else (k * 37) % 101, 0, int(k % 13 == 0), int(k % 3 > 0), 0)
        for e in range(4) for k in range(30)
    ]
    df = spark.createDataFrame(data, watch.RUNS)
    for part in range(3):
        df.where((F.col("run") >= 10 * part) & (F.col("run") < 10 * part + 10)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    watch.run_watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(map(repr, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(repr, watch.decisions(df).collect()))


def test_alerts_once(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    schema = "entry long, tag long, published_at timestamp, score long"
    spark.createDataFrame([(1, t, base, s) for t, s in ((1, 10), (1, 10), (2, 80), (3, 44))], schema).write.parquet(str(tmp_path / "in"))
    ledger.alerts(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.tag for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "3"]


def test_late_alerts_are_sent_and_memory_is_bounded(spark, tmp_path):
    schema = "entry long, tag long, published_at timestamp, score long"
    late, new = dt.datetime(2024, 1, 1), dt.datetime(2026, 1, 1)
    batches = [[(1, 1, new, 10)], [(1, 2, late, 10), (2, 1, late, 20), (1, 1, new, 10), (1, 9, None, 1)], [(1, 2, late, 10), (1, 3, late, 90)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ledger.alerts(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted((r.entry, r.tag) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "1"), (1, "2"), (1, "9"), (2, "1")]


def test_author_ledger_stream_equals_batch_in_any_order(spark, tmp_path):
    rng = random.Random(7)
    rows = [(e, o, f"v{o}", f"k{k}", f"N{k}.{o}", 1 + (k * o) % 4) for e in (1, 2) for o in range(1, 9) for k in range(6) if rng.random() < 0.6]
    told = rows + rows[:7]
    rng.shuffle(told)
    df = spark.createDataFrame(rows, ledgers.ACTIVITY)
    for k in range(3):
        spark.createDataFrame(told[k::3], ledgers.ACTIVITY).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ledgers.ACTIVITY).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ledgers.replay(ledgers.author_changes(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    changes = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, ledgers.latest(changes).collect())) == sorted(map(tuple, ledgers.author_totals(df).collect()))
    assert changes.where("evicted").count() == 0
    assert changes.agg(F.max("version")).first()[0] == 3


def test_author_ledger_lets_go_and_says_so(spark, tmp_path):
    rows = [(1, o, f"v{o}", f"k{o}", "n", o) for o in range(1, 5)]
    for r in rows:
        spark.createDataFrame([r], ledgers.ACTIVITY).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ledgers.ACTIVITY).parquet(str(tmp_path / "in"))
        ledgers.replay(ledgers.author_changes(stream, cap=2), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r.version, r.key, r.evicted) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "k1", False), (2, "k2", False), (3, "k3", True), (4, "k4", True)]


RELEASES = "entry long, tag string, published_at long, draft boolean, prerelease boolean"


def test_next_releases(spark):
    rel = spark.createDataFrame([(e, f"v{k}", k, k == 6, k == 5) for e in (1, 2) for k in range(1, 8)] + [(1, "undated", None, False, False)], RELEASES)
    cursors = spark.createDataFrame([(1, 2)], "entry long, cursor long")
    got = {(r.entry, r.tag, r.place, r.skipped) for r in watch.next_releases(rel, cursors, cap=2).collect()}
    assert got == {(1, "v4", 1, 1), (1, "v7", 2, 1), (2, "v7", 1, 0)}
    assert watch.next_releases(rel, cursors, prereleases=True, pattern="^v[45]$").where("entry = 1").count() == 2


def test_stale_rules(spark):
    rules = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "entry long, rule string")
    checks = spark.createDataFrame([(1, k, True) for k in range(10)] + [(2, k, k < 9) for k in range(12)], "entry long, tag long, measured boolean")
    hits = spark.createDataFrame([(1, "a")], "entry long, rule string")
    assert [(r.entry, r.rule) for r in watch.stale_rules(rules, checks, hits).collect()] == [(1, "b")]


def test_promises_age(spark):
    base = spark.createDataFrame([(1, "new", "New"), (1, "again", "Again")], "entry long, key string, text string")
    carried = spark.createDataFrame([(1, "again", "Again", 4), (1, "old", "Old", 8), (1, "older", "Older", 9)], "entry long, key string, text string, carried_for int")
    kept = spark.createDataFrame([(1, "new", "kept")], "entry long, key string, status string")
    got = {r.key: (r.carried_for, r.status) for r in watch.aged_promises(base, carried, kept).collect()}
    assert got == {"new": (0, "kept"), "again": (0, "still-open"), "old": (9, "still-open"), "older": (10, "stale")}


def test_targets(spark):
    cases = [("next", "x", True), ("3.0", "v3.0.0", True), ("3.1", "v3.0.9", False), ("2", "v10", True), ("soon", "v1", False), (None, "v1", False), ("1.2.3", "rel-1.2", False)]
    df = spark.createDataFrame([(t, h) for t, h, _ in cases], "t string, h string")
    assert [r[0] for r in df.select(watch.target_reached(F.col("t"), F.col("h"))).collect()] == [w for *_, w in cases]


def test_author_ledger(spark):
    known = spark.createDataFrame([(1, "a", "A", "v1", "v1", 1, 5), (1, "b", "B", "v1", "v1", 1, 9)], "entry long, key string, name string, first_seen string, last_seen string, releases long, commits long")
    seen = spark.createDataFrame([(1, "v2", "a", "A2", 2), (1, "v2", "c", "C", 1)], "entry long, tag string, key string, name string, commits long")
    got = {r.key: (r.name, r.first_seen, r.last_seen, r.releases, r.commits, r.dropped) for r in watch.author_ledger(known, seen, cap=2).collect()}
    assert got == {"a": ("A2", "v1", "v2", 2, 7, 1), "c": ("C", "v2", "v2", 1, 1, 1)}
    assert watch.author_ledger(known, seen, cap=1).count() == 2
