"""The long view of a series of checks: what each phase was like, and the events that stand out in the record.

checks: entry, tag, ord (unique in its entry, ascending), published_at (timestamp, may be null), score, label, generation,
top (the identity with most commits), share (of its commits), day (days since any epoch), authors (identities),
flagged, critical, broken (promises). Columns but entry, tag and ord may be null; a null count is none. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import history

# Fixed values of the record: kinds of events, most telling first, how many are shown, and the share that makes a new identity one.
PRIORITY = ("level-shift", "top-change", "concentration", "cadence", "critical", "new-top-author", "broken-promise", "flagged")
REASON_KINDS = {"level": "level-shift", "author": "top-change", "share": "concentration", "cadence": "cadence"}
SHOWN = 20
NEW_TOP_SHARE = 0.5


def with_phase(checks: DataFrame, phases: DataFrame) -> DataFrame:
    """Checks with the ``phase`` that holds them: a phase meets its first check by equality, a running value carries it on.

    phases: as of ``history.phase_table``. No range join: one exchange by entry serves the places, the join and the running value."""
    w = Window.partitionBy("entry").orderBy("ord")
    placed = checks.withColumn("pos", (F.row_number().over(w) - 1).cast("long"))
    starts = phases.select("entry", "pos", F.col("phase").alias("_starts"))
    carried = F.last("_starts", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return placed.join(starts, ["entry", "pos"], "left").withColumn("phase", carried).drop("_starts")


def _half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("long")


def phase_stats(checks: DataFrame, phases: DataFrame) -> DataFrame:
    """One row per phase: entry, phase, from_tag, to_tag, from_at, to_at, checks, score (median, half up), least, most, authors and gap_days (medians, half up),
    share (median, whole percents), flagged, critical, broken, reasons (kind, old, new).

    Gaps lie between dated checks of the same phase; checks without a date are passed over, as are nulls in medians."""
    rows = with_phase(checks, phases)
    dated = F.last("day", ignorenulls=True).over(Window.partitionBy("entry", "phase").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_gap", F.col("day") - dated)
    by_place = lambda f, c: f(F.struct("ord", c)).getField(c)
    stats = rows.groupBy("entry", "phase").agg(
        by_place(F.min, "tag").alias("from_tag"), by_place(F.max, "tag").alias("to_tag"),
        by_place(F.min, "published_at").alias("from_at"), by_place(F.max, "published_at").alias("to_at"),
        F.count(F.lit(1)).alias("checks"), _half_up(F.median("score")).alias("score"), F.min("score").alias("least"), F.max("score").alias("most"),
        _half_up(F.median("authors")).alias("authors"), _half_up(F.median("share") * 100).alias("share"), _half_up(F.median("_gap")).alias("gap_days"),
        F.count_if(F.coalesce("flagged", F.lit(False))).alias("flagged"),
        F.coalesce(F.sum("critical"), F.lit(0)).cast("long").alias("critical"), F.coalesce(F.sum("broken"), F.lit(0)).cast("long").alias("broken"),
    )
    return stats.join(phases.select("entry", "phase", "reasons"), ["entry", "phase"])


def _plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n > 1, "s").otherwise(""))


def _transition(kind: Column, old: Column, new: Column) -> Column:
    number = lambda c: F.regexp_replace(c, "%", "").cast("long")
    rose = number(new) > number(old)
    said = F.concat(old, F.lit(" → "), new)
    return (
        F.when(kind == "level", F.concat(F.lit("score level "), F.when(rose, "rose").otherwise("fell"), F.lit(": "), said))
        .when(kind == "author", F.concat(F.lit("top author changed: "), said))
        .when(kind == "share", F.concat(F.lit("commit concentration "), F.when(rose, "jumped").otherwise("spread out"), F.lit(": top identity "), said))
        .otherwise(F.concat(F.lit("release cadence changed: every ~"), old, F.lit(" days → ~"), new, F.lit(" days")))
    )


def events(checks: DataFrame, phases: DataFrame, ledger: DataFrame) -> DataFrame:
    """entry, pos, tag, published_at, kind, text: what opened phases, critical and flagged checks (critical ones once), broken promises, and
    identities that hold half a release in which they are first seen (never the first check, where all are new).

    ledger: entry, name, first_tag; repeated rows count once."""
    w = Window.partitionBy("entry").orderBy("ord")
    placed = checks.withColumn("pos", (F.row_number().over(w) - 1).cast("long"))
    opened = phases.select("entry", "pos", F.explode("reasons").alias("r")).select("entry", "pos", "r.*")
    first = ledger.select("entry", F.col("name").alias("top"), F.col("first_tag").alias("tag"), F.lit(True).alias("_new")).distinct()
    rows = placed.join(first, ["entry", "top", "tag"], "left")
    scored = F.concat(F.col("score").cast("string"), F.lit(" ("), F.col("label"), F.lit(")"))
    critical, broken, share = F.coalesce("critical", F.lit(0)), F.coalesce("broken", F.lit(0)), F.coalesce("share", F.lit(0.0))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    found = F.array_compact(
        F.array(
            F.when(critical > 0, event("critical", F.concat(_plural(critical, "critical flag"), F.lit(", scored "), scored))).when(
                F.coalesce("flagged", F.lit(False)), event("flagged", F.concat(F.lit("flagged at "), scored))
            ),
            F.when(broken > 0, event("broken-promise", F.concat(_plural(broken, "promise"), F.lit(" from earlier notes broken")))),
            F.when(
                F.col("_new") & (F.col("pos") > 0) & (share >= NEW_TOP_SHARE),
                event("new-top-author", F.concat("top", F.lit(", first seen in this release, authored "), _half_up(share * 100).cast("string"), F.lit("% of its commits"))),
            ),
        )
    )
    columns = ["entry", "pos", "tag", "published_at", "kind", "text"]
    kinds = F.create_map(*[F.lit(x) for pair in REASON_KINDS.items() for x in pair])
    turns = opened.join(placed, ["entry", "pos"]).select(*columns[:4], kinds[F.col("kind")].alias("kind"), _transition(F.col("kind"), F.col("old"), F.col("new")).alias("text"))
    return turns.unionByName(rows.select(*columns[:4], F.explode(found).alias("e")).select(*columns[:4], "e.*"))


def selected_events(found: DataFrame, shown: int = SHOWN) -> DataFrame:
    """The ``shown`` most telling events of each entry, ``place`` from 1 in the record's order (pos, kind), and how many the entry has (``found``).

    The cut ranks by kind and then by time, so that ranks above the cut leave in map tasks; the record's order is restored after it.
    Events carry what they say, so two of one kind at one check (none by construction) go by text."""
    rank = F.array_position(F.array(*[F.lit(k) for k in PRIORITY]), F.col("kind"))
    best = F.row_number().over(Window.partitionBy("entry").orderBy(rank, "pos", "text"))
    kept = found.withColumn("_best", best).where(F.col("_best") <= shown).drop("_best")
    place = F.row_number().over(Window.partitionBy("entry").orderBy("pos", "kind", "text")).cast("long")
    return kept.withColumn("place", place).join(found.groupBy("entry").agg(F.count(F.lit(1)).alias("found")), "entry")
