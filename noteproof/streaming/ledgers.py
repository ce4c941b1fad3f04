"""Ledgers as keyed state: alerts that were sent and identities that were seen, per entry, in Spark's state store.

Both hold a map per entry and are bounded; what is let go is told by a flag that stays. Neither uses a watermark, so no late row is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Alerts that an entry remembers, and identities that its ledger holds beside those of the release at hand.
ALERTS_KEPT, AUTHORS_KEPT = 1_000, 100
#: Pairs of release and identity that an entry remembers as counted; of more, those of the oldest releases are let go and count again if told again.
TOLD_KEPT = 10_000
ALERTS = "entry long, tag string, published_at timestamp, score long"
ACTIVITY = "entry long, ord long, tag string, key string, name string, commits long"
AUTHORS = "entry long, key string, name string, first_seen string, last_seen string, first_ord long, last_ord long, releases long, commits long, version long, evicted boolean"


def keyed_state(spark: SparkSession) -> None:
    """Map state needs the store that can hold many values a key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class SentAlerts(StatefulProcessor):
    """Sends each (entry, tag) once. The ``kept`` alerts published last are remembered; one that was let go is sent again if it is delivered
    again, so that a full memory costs a repeated alert and never a lost one."""

    def __init__(self, kept: int):
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sent = handle.getMapState("sent", "tag string", "published long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            new = []
            for tag, at, score in zip(pdf["tag"], pdf["published_at"], pdf["score"], strict=True):
                if not self.sent.containsKey((tag,)):
                    new.append((key[0], tag, at, score))
                    self.sent.updateValue((tag,), (0 if pd.isna(at) else int(pd.Timestamp(at).value // 1000),))
            held = sorted((v[0], k[0]) for k, v in self.sent.iterator())
            for _, tag in held[: max(0, len(held) - self.kept)]:
                self.sent.removeKey((tag,))
            if new:
                yield pd.DataFrame(new, columns=["entry", "tag", "published_at", "score"])

    def close(self) -> None:
        pass


def alerts(checks: DataFrame, *, below: int = 45, kept: int = ALERTS_KEPT) -> DataFrame:
    """A stream of checks (``ALERTS``) to those scored under ``below``, each (entry, tag) once however often and late it is delivered."""
    keyed_state(checks.sparkSession)
    low = checks.where(F.col("score") < below).select("entry", F.col("tag").cast("string").alias("tag"), "published_at", "score")
    return low.groupBy("entry").transformWithStateInPandas(SentAlerts(kept), ALERTS, "Append", "None")


class AuthorLedger(StatefulProcessor):
    """Folds releases' identities into the entry's ledger and emits the rows that changed.

    Sights, releases and commits are folded by the release's order, so deliveries in another order give the same ledger; over
    ``cap`` the identities with the fewest commits that were not active in this batch are let go, and the entry's flag stays set from then on."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "key string", "name string, first_seen string, last_seen string, first_ord long, last_ord long, releases long, commits long")
        self.told = handle.getMapState("told", "ord long, key string", "commits long")
        self.flags = handle.getValueState("flags", "version long, evicted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        version, evicted = self.flags.get() if self.flags.exists() else (0, False)
        active: dict[str, tuple] = {}
        for pdf in rows:
            for at, tag, who, name, commits in zip(pdf["ord"].astype(int), pdf["tag"], pdf["key"], pdf["name"], pdf["commits"].astype(int), strict=True):
                at, commits = int(at), int(commits)
                # a release told again counts once
                if self.told.containsKey((at, who)):
                    continue
                self.told.updateValue((at, who), (commits,))
                held = active.get(who) or (tuple(self.known.getValue((who,))) if self.known.containsKey((who,)) else (name, tag, tag, at, at, 0, 0))
                old, first, last, lo, hi, releases, total = held
                if at <= lo:
                    first, lo = tag, at
                if at >= hi:
                    old, last, hi = name, tag, at
                active[who] = (old, first, last, lo, hi, releases + 1, total + commits)
        for who, row in active.items():
            self.known.updateValue((who,), row)
        idle = sorted((row[6], k[0]) for k, row in self.known.iterator() if k[0] not in active)
        for _, who in idle[: max(0, len(idle) - max(0, self.cap - len(active)))]:
            self.known.removeKey((who,))
            evicted = True
        told = sorted(k for k, _ in self.told.iterator())
        for pair in told[: max(0, len(told) - TOLD_KEPT)]:
            self.told.removeKey(pair)
        version += 1
        self.flags.update((version, evicted))
        if active:
            yield pd.DataFrame([(key[0], who, *row, version, evicted) for who, row in sorted(active.items())], columns=[c.split()[0] for c in AUTHORS.split(", ")])

    def close(self) -> None:
        pass


def author_changes(activity: DataFrame, cap: int = AUTHORS_KEPT) -> DataFrame:
    """A stream of releases' identities (``ACTIVITY``) to the ledger rows that each batch changed (``AUTHORS``); of a key the highest version holds."""
    keyed_state(activity.sparkSession)
    return activity.groupBy("entry").transformWithStateInPandas(AuthorLedger(cap), AUTHORS, "Append", "None")


def latest(changes: DataFrame) -> DataFrame:
    """entry, key, name, first_seen, last_seen, releases, commits: the last change of each identity."""
    columns = ["name", "first_seen", "last_seen", "releases", "commits"]
    last = changes.groupBy("entry", "key").agg(F.max_by(F.struct(*columns), "version").alias("row"))
    return last.select("entry", "key", *[F.col(f"row.{c}").alias(c) for c in columns])


def author_totals(activity: DataFrame) -> DataFrame:
    """The batch twin of ``latest`` over all activity: partial sums, nothing let go."""
    once = activity.dropDuplicates(["entry", "ord", "key"])
    held = once.groupBy("entry", "key").agg(
        F.max_by("name", "ord").alias("name"), F.min_by("tag", "ord").alias("first_seen"), F.max_by("tag", "ord").alias("last_seen"),
        F.count(F.lit(1)).alias("releases"), F.sum("commits").alias("commits"),
    )
    return held.select("entry", "key", "name", "first_seen", "last_seen", "releases", "commits")


def capped(totals: DataFrame, cap: int = AUTHORS_KEPT) -> DataFrame:
    """The busiest ``cap`` identities of each entry, and how many there are beyond."""
    place = F.row_number().over(Window.partitionBy("entry").orderBy(F.desc("commits"), "key"))
    return totals.withColumn("place", place.cast("long")).where(F.col("place") <= cap)


def replay(frame: DataFrame, out: str, checkpoint: str) -> None:
    """Run a stream until its source is used up, appending to the table ``out``; the checkpoint makes a restart go on where it ended."""
    frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
