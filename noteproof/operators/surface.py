"""Surface deltas: what appeared and what went, after both sides cancel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def delta(rows: DataFrame, key: str, value: str, added: Column) -> DataFrame:
    """key, appeared, gone: sorted sets of values seen on one side only."""
    sides = rows.groupBy(key).agg(F.collect_set(F.when(added, F.col(value))).alias("plus"), F.collect_set(F.when(~added, F.col(value))).alias("minus"))
    return sides.select(key, F.array_sort(F.array_except("plus", "minus")).alias("appeared"), F.array_sort(F.array_except("minus", "plus")).alias("gone"))


def glob_pattern(glob: str) -> str:
    """Anchored regular expression of a path glob; a match may end at any folder boundary."""
    import re

    parts = []
    for segment in glob.strip("/").split("/"):
        parts.append("(?:[^/]+/)*" if segment == "**" else "".join("[^/]*" if c == "*" else re.escape(c) for c in segment) + "/")
    return "^" + "".join(parts)[: -1 if not glob.endswith("**") else None] + ("" if glob.endswith("**") else "(?:/|$)")


def rule_hits(facts: DataFrame, rules: list[tuple[str, str]], path: str) -> DataFrame:
    """rule and the fact's columns; ``rules``: a handful of (name, glob) from configuration, one pass over the facts."""
    matched = F.filter(
        F.array(*[F.when(F.col(path).rlike(glob_pattern(g)), F.lit(n)) for n, g in rules]),
        lambda r: r.isNotNull(),
    )
    return facts.withColumn("rule", F.explode(matched))
