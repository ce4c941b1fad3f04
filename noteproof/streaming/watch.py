"""The watch loop's state per entry: history by tag, a forward cursor, give-ups, and alert decisions.

``fold`` takes one entry's state and its next runs, in the order they ran, and is all there is to
it: the stream keeps the state in Spark's state store, the batch twin starts from nothing. The
cursor is a high-water mark of published times and not a watermark, so old releases that a backfill brings
late are folded in their place and decided against what was published before them.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed values of the watch rules.
HISTORY_LIMIT, MAX_ATTEMPTS, MAX_SKIPPED = 20, 3, 10
LEVEL_WINDOW, LEVEL_LEAST, DRIFT_WINDOW, DRIFT_LEAST, SCORE_DROP, STREAK = 10, 3, 12, 6, 20, 3
NOTIFY_BELOW = 65
PROMISE_CAP, PROMISE_STALE = 50, 10

#: What a run brings: ``score`` null means that the check failed.
RUNS = "entry long, tag string, published_at timestamp, run long, score long, exit_code long, critical long, unjudged long, rule_hits long"
DECISIONS = "entry long, tag string, run long, action string, level long, drifted boolean, streak long, flagged boolean"
STATE = "state string"


def _level(scores: list[int]) -> int | None:
    """Median of the scores, half up; None under three."""
    if len(scores) < LEVEL_LEAST:
        return None
    s = sorted(scores)
    return math.floor((s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2 + 0.5)


def _drifted(scores: list[int]) -> bool:
    last = scores[-DRIFT_WINDOW:]
    half = len(last) // 2
    if len(last) < DRIFT_LEAST:
        return False
    return _level(last[:half]) - _level(last[len(last) - half :]) >= SCORE_DROP


def _forward(state: dict, at: int | None, tag: str) -> None:
    if at is not None and (state["cursor"] is None or at > state["cursor"]):
        state["cursor"], state["cursor_tag"] = at, tag


def _failed(state: dict, row: dict) -> str:
    """Count a failed run: the third on one tag in a row gives it up and moves the cursor past it."""
    held = state["failing"]
    attempts = (held[1] if held and held[0] == row["tag"] else 0) + 1
    if attempts < MAX_ATTEMPTS:
        state["failing"] = [row["tag"], attempts]
        return "retry"
    state["failing"] = None
    state["skipped"] = [*state["skipped"], row["tag"]][-MAX_SKIPPED:]
    _forward(state, row["at"], row["tag"])
    return "skip"


def fold(state: dict | None, rows: list[dict], limit: int = HISTORY_LIMIT, notify_below: int = NOTIFY_BELOW) -> tuple[dict, list[tuple]]:
    """The state after ``rows`` (tag, at, run, score, exit_code, critical, unjudged, rule_hits) and a decision per row."""
    state = state or {"cursor": None, "cursor_tag": None, "history": [], "failing": None, "skipped": []}
    out = []
    for row in sorted(rows, key=lambda r: (r["run"], r["tag"])):
        if row["score"] is None:
            out.append((row["tag"], row["run"], _failed(state, row), None, False, 0, False))
            continue
        when = lambda h: h["at"] if h["at"] is not None else h["run"]
        # a release checked again takes its earlier check's place
        others = [h for h in state["history"] if h["tag"] != row["tag"]]
        past = [h["score"] for h in others if when(h) < when(row) or (when(h) == when(row) and h["run"] < row["run"])]
        level, drifted = _level(past[-LEVEL_WINDOW:]), _drifted([*past, row["score"]])
        streak = 0
        for h in sorted([*others, row], key=lambda h: h["run"], reverse=True):
            if not h["unjudged"]:
                break
            streak += 1
        low = row["score"] < notify_below if level is None else row["score"] <= level - SCORE_DROP
        flagged = row["exit_code"] > 0 or row["critical"] > 0 or low or drifted or streak >= STREAK or row["rule_hits"] > 0
        kept = {k: row[k] for k in ("tag", "at", "run", "score", "unjudged")}
        state["history"] = sorted([*others, kept], key=lambda h: (when(h), h["run"]))[-limit:]
        state["failing"] = None
        _forward(state, row["at"], row["tag"])
        out.append((row["tag"], row["run"], "checked", level, drifted, streak if streak >= STREAK else 0, flagged))
    return state, out


def _rows(pdf: pd.DataFrame) -> list[dict]:
    number = lambda x, none=None: none if pd.isna(x) else int(x)
    return [
        {
            "tag": r.tag, "at": None if pd.isna(r.published_at) else int(pd.Timestamp(r.published_at).value // 1000), "run": int(r.run), "score": number(r.score),
            "exit_code": number(r.exit_code, 0), "critical": number(r.critical, 0), "unjudged": number(r.unjudged, 0), "rule_hits": number(r.rule_hits, 0),
        }
        for r in pdf.itertuples(index=False)
    ]


def _table(entry: int, decisions: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame([(entry, *d) for d in decisions], columns=[c.split()[0] for c in DECISIONS.split(", ")])
    return frame.astype({"level": "Int64"})


def decisions(runs: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """The batch twin: decisions over all runs (``RUNS``), each entry from an empty state."""

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _table(key[0], fold(None, _rows(pdf), limit)[1])

    return runs.groupBy("entry").applyInPandas(walk, DECISIONS)


def stream_decisions(runs: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """The same over a stream of runs: each batch's runs are folded into the entry's state, which never holds more than ``limit`` checks."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts))
        state, out = fold(json.loads(held.get[0]) if held.exists else None, _rows(pdf), limit)
        held.update((json.dumps(state),))
        yield _table(key[0], out)

    return runs.groupBy("entry").applyInPandasWithState(step, DECISIONS, STATE, "append", GroupStateTimeout.NoTimeout)


def run_watch(spark, source: str, out: str, checkpoint: str, *, files_per_trigger: int = 1) -> None:
    """Replay a folder of parquet files of runs as a stream; decisions are appended to ``out`` once."""
    runs = spark.readStream.schema(RUNS).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    query = stream_decisions(runs).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def eligible(releases: DataFrame, *, prereleases: bool = False, pattern: str | None = None) -> DataFrame:
    """Releases that may be checked: dated, no drafts, prereleases on request, tags of the pattern if there is one."""
    kept = releases.where(~F.coalesce("draft", F.lit(False)) & F.col("published_at").isNotNull())
    if not prereleases:
        kept = kept.where(~F.coalesce("prerelease", F.lit(False)))
    return kept if pattern is None else kept.where(F.col("tag").rlike(pattern))


def next_releases(releases: DataFrame, cursors: DataFrame, cap: int = 3, **options) -> DataFrame:
    """entry, tag, published_at, place, skipped: what an ordinary run checks, oldest first.

    releases: entry, tag, published_at, draft, prerelease; cursors: entry, cursor. Without a cursor only the latest;
    else the newest ``cap`` after it, and how many more there were."""
    from pyspark.sql import Window

    found = eligible(releases, **options).join(cursors.select("entry", "cursor"), "entry", "left")
    after = found.where("cursor is null or published_at > cursor")
    newest = Window.partitionBy("entry").orderBy(F.desc("published_at"), F.desc("tag"))
    ranked = after.withColumn("age", F.row_number().over(newest)).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("entry")))
    kept = ranked.where(F.col("age") <= F.when(F.col("cursor").isNull(), 1).otherwise(cap))
    skipped = F.when(F.col("cursor").isNull(), 0).otherwise(F.greatest(F.lit(0), F.col("all") - cap))
    place = F.row_number().over(Window.partitionBy("entry").orderBy("published_at", "tag"))
    return kept.select("entry", "tag", "published_at", place.cast("long").alias("place"), skipped.cast("long").alias("skipped"))


def stale_rules(rules: DataFrame, checks: DataFrame, hits: DataFrame, least: int = 10) -> DataFrame:
    """entry, rule: rules that no check hit, of entries with ``least`` checks or more that carry rules.

    rules: entry, rule; checks: entry, tag, measured; hits: entry, rule."""
    enough = checks.where("measured").groupBy("entry").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("entry")
    return rules.join(enough, "entry", "left_semi").join(hits.select("entry", "rule").distinct(), ["entry", "rule"], "left_anti").select("entry", "rule")


def aged_promises(base: DataFrame, carried: DataFrame, kept: DataFrame) -> DataFrame:
    """entry, key, text, carried_for, status, place: one check's promises, open ones first, ``PROMISE_CAP`` at most.

    base: entry, key, text of this base release's promises; carried: the same and carried_for of the
    ledger's open ones, which have now ridden one release more; kept: entry, key of what the diff resolves, status.
    An open promise carried ``PROMISE_STALE`` times is stale."""
    from pyspark.sql import Window

    riding = carried.join(base.select("entry", "key"), ["entry", "key"], "left_anti").withColumn("carried_for", F.coalesce("carried_for", F.lit(0)) + 1)
    rows = base.withColumn("carried_for", F.lit(0)).unionByName(riding.select("entry", "key", "text", "carried_for")).join(kept, ["entry", "key"], "left")
    status = F.coalesce("status", F.when(F.col("carried_for") >= PROMISE_STALE, "stale").otherwise("still-open"))
    rows = rows.withColumn("status", status).withColumn("place", F.row_number().over(Window.partitionBy("entry").orderBy(status != "still-open", "carried_for", "key")))
    return rows.where(F.col("place") <= PROMISE_CAP).select("entry", "key", "text", "carried_for", "status", "place")


def target_reached(target, head):
    """Whether the release that a promise names is reached: "next" always, else the first dotted numbers compared; false where one has none."""
    parts = lambda c: F.split(F.regexp_extract(c, r"\d+(?:\.\d+)*", 0), r"\.")
    numbers = lambda c: F.transform(parts(c), lambda x: x.cast("decimal(38,0)"))
    longest = F.greatest(F.size(parts(target)), F.size(parts(head)))
    at = lambda xs, i: F.coalesce(F.get(xs, i), F.lit(0).cast("decimal(38,0)"))
    signs = F.transform(F.sequence(F.lit(0), longest - 1), lambda i: F.signum(at(numbers(head), i) - at(numbers(target), i)).cast("int"))
    first = F.get(F.filter(signs, lambda s: s != 0), F.lit(0))
    known = target.rlike(r"\d") & head.rlike(r"\d")
    return F.when(target == "next", True).otherwise(F.coalesce(known & (F.coalesce(first, F.lit(1)) > 0), F.lit(False)))


def author_ledger(ledger: DataFrame, activity: DataFrame, cap: int = 100) -> DataFrame:
    """entry, key, name, first_seen, last_seen, releases, commits, dropped: one release's authors folded into the ledger.

    ledger: the same columns but dropped; activity: entry, tag, key, name, commits. First sights never change; all of this release's
    authors stay, then the busiest, ``cap`` together; ``dropped`` tells how many of the entry were let go."""
    from pyspark.sql import Window

    known = ledger.select("entry", "key", F.col("name").alias("old"), "first_seen", "last_seen", "releases", F.col("commits").alias("before"))
    both = known.join(activity.select("entry", "key", "tag", "name", "commits"), ["entry", "key"], "full")
    active = F.col("tag").isNotNull()
    folded = both.select(
        "entry", "key", F.coalesce("name", "old").alias("name"), F.coalesce("first_seen", "tag").alias("first_seen"), F.coalesce("tag", "last_seen").alias("last_seen"),
        (F.coalesce("releases", F.lit(0)) + active.cast("int")).cast("long").alias("releases"), (F.coalesce("before", F.lit(0)) + F.coalesce("commits", F.lit(0))).cast("long").alias("commits"), active.alias("active"),
    )
    place = F.row_number().over(Window.partitionBy("entry").orderBy(F.desc("active"), F.desc("commits"), "key"))
    ranked = folded.withColumn("kept", (place <= cap) | F.col("active"))
    counted = ranked.withColumn("dropped", F.count_if(~F.col("kept")).over(Window.partitionBy("entry")))
    return counted.where("kept").drop("kept", "active")
